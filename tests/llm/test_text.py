import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import DATA, WORD, frame, table
from tidewell.llm import chat, language_id, licenses, pieces, quality

EDGE = [(1, None, "en", "a"), (2, "", "en", None), (3, " 12 \n", None, "a"), (None, "some words here", "en", "a"), (5, "some words here", "en", "a"), (5, "some words here", "en", "a"), (6, "mot " * 40_000, "fr", "b")]


# language ID


def parse(text, sample):
    """Phrases of a greedy parse of the whole ``text`` into longest substrings of ``sample``."""
    n = at = 0
    while at < len(text):
        end, where = at + 1, sample.find(text[at])
        while where >= 0 and end < len(text) and (where := sample.find(text[at : end + 1], where)) >= 0:
            end += 1
        at = end
        n += 1
    return n


def parsed(sample, texts, width, piece, table_bytes):
    a = language_id.Automaton(*language_id.transitions([ord(c) - 97 for c in sample], width), width, len(sample), table_bytes)
    symbols = np.array([ord(c) - 97 for t in texts for c in t], np.int32)
    sizes = np.array([len(t) for t in texts])
    return a.phrases(symbols, np.cumsum(sizes) - sizes, sizes, piece).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=60), st.lists(st.text("abcd", max_size=60), min_size=1, max_size=5), st.integers(1, 70), st.sampled_from([0, 1 << 20]))
def test_phrases_are_those_of_a_greedy_parse(sample, texts, piece, table_bytes):
    """Whatever the size of pieces, and with and without a table."""
    assert parsed(sample, texts, 5, piece, table_bytes) == [parse(t, sample) for t in texts]


def test_periodic_texts_and_copies_of_the_sample_are_parsed_whole():
    """Texts on which parses from different places never meet, and one that the sample holds whole."""
    random.seed(3)
    sample = "".join(random.choice("abc") for _ in range(3000)) + "abab" + "ccc"
    texts = ["ab" * 2000, "c" * 1999, sample, sample[500:2500] + "d" + sample[:700], "", "d" * 50]
    for table_bytes in (0, 1 << 24):
        assert parsed(sample, texts, 5, 64, table_bytes) == [parse(t, sample) for t in texts]
    assert parsed(sample, [sample[:3000]], 5, language_id.PIECE, 1 << 24) == [1]


def brute_language(text, samples):
    """The prediction by parsing with string searches, over the rule of separators alone."""
    reduced = lambda t: "".join(c if c.isalpha() else " " for c in t.lower())
    squeeze = lambda t: re.sub(" +", " ", reduced(t))
    own = squeeze(text or "")
    if not any(c.isalpha() for c in own):
        return "und", 0.0
    costs = {k: parse(own, squeeze(s)) * float(np.log2(len(squeeze(s)) + 2)) / len(own) for k, s in samples.items()}
    first, *rest = sorted(costs, key=lambda k: (costs[k], k))
    return first, 1 - costs[first] / costs[rest[0]] if rest else 1.0


def test_language_id_matches_brute_force(spark):
    """Every whole text of the table, with the sample that the model learns from."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    samples = language_id.sample(docs)
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    for r in language_id.op6_language_id(spark, DATA).collect():
        name, score = brute_language(texts[r["doc_id"]], samples)
        assert r["lang_pred"] == name and r["score"] == pytest.approx(score, abs=1e-9)


def test_languages_of_many_letters_are_told_apart(spark):
    """Two languages of 3,000 letters each, in ranges of their own; every letter counts."""
    random.seed(6)
    word = lambda low: "".join(chr(low + random.randrange(3000)) for _ in range(4))
    rows = [(k, " ".join(word(0x4E00 if k % 2 else 0x6000) for _ in range(1500)), "xa" if k % 2 else "xb", None) for k in range(40)]
    samples = language_id.sample(frame(spark, rows))
    model = language_id.Model(language_id.build(samples))
    assert len(model.symbols.of[model.symbols.of > 0]) and model.symbols.other > 5900
    for low, name in ((0x4E00, "xa"), (0x6000, "xb")):
        text = " ".join(word(low) for _ in range(30))
        got = model.predict([text])
        assert got[0] == [name] and (got[0][0], pytest.approx(got[1][0])) == brute_language(text, samples)
    small = language_id.Model(language_id.build(samples), 0)
    assert small.predict([text, None, "12"]) == model.predict([text, None, "12"])


def test_language_sample_is_bounded_and_fair(spark, monkeypatch):
    """Rows without an id spread over the hash, copies count once, and a flood in one language leaves the others theirs."""
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 5)
    rows = [(None, f"flood number {k} of many words", "aa", None) for k in range(300)] + [(0, "the same again", "ab", None)] * 50
    rows += [(k, f"other words {k}", "zz", None) for k in range(1000, 1040)]
    got = language_id.sample(frame(spark, rows))
    assert sorted(got) == ["aa", "ab", "zz"] and got["ab"] == "the same again"
    assert len(got["aa"].split("\n")) == 5 and len(got["zz"].split("\n")) == 5


def test_language_id_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in table("documents")}
    rows = language_id.op6_language_id(spark, DATA).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_language_id_ignores_labels_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert language_id.sample(docs) == language_id.sample(other)


def test_language_id_edge_cases(spark):
    rows = language_id.identify(frame(spark, EDGE)).select("doc_id", "_language.*", "node").collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert (r["lang_pred"] == "und" and r["score"] == 0 and r["n_letters"] == 0) == (r["doc_id"] in (1, 2, 3))
    assert language_id.identify(frame(spark, [])).collect() == []
    none = language_id.identify(frame(spark, [(1, "some words", None, None)])).select("_language.*").collect()
    assert [tuple(r) for r in none] == [("und", 0.0, 9)]


# license scan


def license_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_base(text):
    words, places, labels = license_words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan_matches_brute_force(spark):
    truth = {r["doc_id"]: brute_base(r["text"]) for r in table("documents")}
    for r in licenses.op3_license_scan(spark, DATA).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == truth[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["cc", "by", "general", "public", "license", "all", "rights", "reserved", "É", "x1", "CC", "İ", "\u212a"]), max_size=30))
def test_license_places_of_any_words(words):
    text = " ".join(words)
    found = licenses.words_of(text)
    places, base, _, _ = licenses.Index().scan(found)
    got = len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))
    assert got == brute_base(text)


def test_license_templates_allow_gaps_but_need_their_key_phrases():
    index = licenses.Index()
    labels = lambda t: index.scan(licenses.words_of(t))[2]
    assert "apache-2.0" in labels("x y Licensed under the Apache License, Version 2.0 (the License)")
    assert "mit" in labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files")
    assert "gpl-3.0" not in labels("licensed under the gnu general public licence version 3")
    assert labels("the license of the public is general") == set()


def test_license_scan_edge_cases(spark):
    rows = licenses.scan(frame(spark, [*EDGE, (8, "cc by cc by", None, None)])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGE) + 1 and by[1]["n_words"] == 0 and by[2]["first_word"] is None and by[6]["n_words"] == 40_000
    assert (by[8]["n_base"], by[8]["first_word"], by[8]["last_word"], by[8]["labels"]) == (2, 0, 2, "cc-by")
    assert licenses.scan(frame(spark, [])).collect() == []


# chat formatting


def plain(turns):
    turns = sorted(((t, r or "", x or "") for t, r, x in turns), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    said = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    loss = "".join(x for _, r, x in turns if r == "assistant")
    return len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_matches_the_conversations(spark):
    turns = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in table("conversations"):
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    rows = chat.op4_chat_formatting(spark, DATA).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows} == {c: plain(t) for c, t in turns.items()}
    for r in rows:
        full = chat.render([(role or "", text or "") for _, role, text in sorted(turns[r["conv_id"]])])
        assert r["formatted_chars"] == len(full) and not r["rewrites_history"]


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "b\\"), (1, 1, "assistant", "b\\"), (None, None, "tool [/ROLE]", "<s>"), (None, 3, "assistant", "<\\s>"), (2, 0, "assistant", "y" * 100_000)]
    rows += [(5, k, "user" if k % 2 else "assistant", f"[INST] {k} </s>") for k in range(60)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, key string")
    by = {}
    for c, *t in rows:
        by.setdefault(c, []).append(t)
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == {c: plain(t) for c, t in by.items()}
    assert not any(r["rewrites_history"] for r in got.values())
    out = chat.format_turns(df).filter("conv_id = 5").orderBy("turn_at").collect()
    assert "".join(r["formatted"] for r in out) == chat.render([(r, t) for _, r, t in by[5]])
    assert chat.digest(df.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"\\<>/s[]INSTROLE a\n", *chat.CONTROL]), max_size=20))
def test_escape_is_reversible_and_leaves_no_control_string(parts):
    text = "".join(parts)
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    drops = lambda ts: "".join(f"[{r}:{t if k == len(ts) - 1 else '...'}]" for k, (r, t) in enumerate(ts))
    assert [s.rewrites for s in chat.spans(iter(turns), chat.Template(drops))] == [False, True, True]
    numbers = lambda ts: "".join(f"{k}:{t};" for k, (_, t) in enumerate(ts))
    found = list(chat.spans(iter(turns * 30), chat.Template(numbers)))
    assert not any(s.rewrites for s in found) and "".join(s.text for s in found) == numbers(turns * 30)
    false = chat.Template(numbers, turn_local=True)  # a declaration that does not hold
    assert any(s.rewrites for s in chat.spans(iter(turns * 30), false))


def test_operators_render_whole_prefixes_of_any_template(spark):
    """Templates with a limit of 20 turns, with numbered turns, and with a system turn in front, over 40 turns."""
    turns = [("system", "s"), *[("user" if k % 2 else "assistant", f"t{k}") for k in range(1, 40)]]
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    limit = lambda ts: "".join(f"[{r}:{t}]" for r, t in ts[-20:])
    numbers = lambda ts: "".join(f"{k}:{t};" for k, (_, t) in enumerate(ts))
    front = lambda ts: "".join(f"<{ts[0][0]}>{t}" for _, t in ts)
    for render, rewrites in ((limit, True), (numbers, False), (front, False)):
        out = chat.format_turns(rows, chat.Template(render)).orderBy("turn_at").collect()
        found = chat.digest(rows, chat.Template(render)).first()
        assert found["rewrites_history"] == any(r["rewrites_history"] for r in out) == rewrites
        if not rewrites:
            assert "".join(r["formatted"] for r in out) == render(turns) and found["formatted_chars"] == len(render(turns))
    assert [r["rewrites_history"] for r in chat.format_turns(rows, chat.Template(limit)).orderBy("turn_at").collect()] == [k >= 20 for k in range(40)]


def test_foreign_templates_give_roles_texts_and_loss(spark):
    """Marks around roles, a marker before the first turn, stripped texts; roles and loss are the turns' own."""
    texts = ["hello <|im_end|>", "  an answer  ", "", "\ue000 and \ue001", "the last, x"]
    turns = [(0, "system", texts[0]), (1, "assistant", texts[1]), (2, "user", texts[2]), (3, "assistant", texts[3]), (4, "assistant", texts[4])]
    rows = spark.createDataFrame([(c, *t) for c in (1, 2) for t in turns], "conv_id bigint, turn bigint, role string, text string")
    safe = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    back = lambda t: t.replace("&lt;", "<").replace("&amp;", "&")
    marks = lambda ts: "<s>" + "".join(f"<|im_start|>{r}\n{safe(t)}<|im_end|>\n" for r, t in ts)
    named = lambda ts: "BEGIN\n" + "".join(f"### {r.title()}:\n{t}\n\n" for r, t in ts)
    strict = lambda ts: ts[0][0] + "".join(f"|{t}|" for _, t in ts)  # fails on an empty conversation
    read = lambda head: head[head.index("<|im_start|>") + 12 : -1]
    for template in (chat.Template(marks, back, read), chat.Template(named), chat.Template(strict)):
        want = plain(turns)
        for r in chat.digest(rows, template).collect():
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want and not r["rewrites_history"]
            assert r["formatted_chars"] == len(template.render([t[1:] for t in turns]))
        out = chat.format_turns(rows.filter("conv_id = 2"), template).orderBy("turn_at").collect()
        assert "".join(r["formatted"] for r in out) == template.render([t[1:] for t in turns])
        assert [r["role"] for r in out] == [t[1] for t in turns] and [r["loss"] for r in out] == [t[1] == "assistant" for t in turns]
    strips = chat.Template(lambda ts: "".join(f"[{t.strip()}]" for _, t in ts))
    out = chat.format_turns(rows.filter("conv_id = 1"), strips).orderBy("turn_at").collect()
    assert [r["formatted"][r["text_start"] : r["text_end"]] for r in out] == [t.strip() for t in texts]
    silent = chat.Template(lambda ts: "".join(f"[{r}]" for r, _ in ts))
    assert all(r["text_start"] == r["text_end"] == len(r["formatted"]) for r in chat.format_turns(rows, silent).collect())


# quality rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab \n\t#|é\x0b\x1c\u3000")), max_size=80))
def test_quality_counts_of_any_text(text):
    assert quality.statistics(text)[0] == brute_counts(text)


def test_quality_matches_brute_force_and_labels(spark):
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    right = total = 0
    for r in quality.op8_quality_rules(spark, DATA).collect():
        counts = brute_counts(texts[r["doc_id"]])
        assert [r[c] for c in quality.COUNTS] == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        if r["doc_id"] in labels:
            total += 1
            right += (r["probability"] >= quality.PASS) == bool(labels[r["doc_id"]])
    assert right >= 0.95 * total


def test_trees_are_monotone_and_learn():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * r.random(3000) < 0.6).astype(float)
    model = quality.fit(x[:2000], y[:2000], (-1, 0, 0))
    assert ((model.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85
    for row in x[:20]:
        line = np.repeat(row[None], 50, 0)
        line[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(model.probability(line)) <= 1e-12).all()
    assert quality.fit(x, np.ones(3000), (0, 0, 0)) is None


def test_scores_match_a_walk_of_each_tree():
    r = np.random.default_rng(5)
    x = r.random((1500, len(quality.FEATURES)))
    y = (x[:, 2] + x[:, 5] * x[:, 7] + 0.1 * r.random(1500) < 0.8).astype(float)
    model = quality.fit(x, y, tuple(quality.MONOTONE.get(f, 0) for f in quality.FEATURES))
    for row, p in zip(x[:200], model.probability(x[:200]), strict=True):
        total = model.base
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] + (1 if row[model.feature[node]] > model.threshold[node] else 0)
            total += model.value[node]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


def test_kept_follows_the_model_and_the_base_rules(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    for r in quality.op8_quality_rules(spark, DATA).collect():
        counts, features = quality.statistics(texts[r["doc_id"]])
        assert r["probability"] == pytest.approx(model.probability(np.array([features]))[0])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["kept"] == (not failed and r["probability"] >= quality.PASS)


def test_repeated_ids_are_learnt_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, monotone: seen.append((len(x), y.tolist())))
    docs = frame(spark, [(1, f"text {k % 3}", None, None) for k in range(50)] + [(2, "other", None, None)])
    quality.train(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert seen == [(2, [0.0, 1.0])]


def test_quality_edge_cases(spark):
    docs = frame(spark, EDGE)
    labels = spark.createDataFrame([(5, None, None), (None, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model is None
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(EDGE) and not any(r["kept"] for r in rows)
    assert next(r for r in rows if r["doc_id"] == 6)["n_repeat_words"] == 40_000
    assert quality.score(frame(spark, []), model).collect() == []


# SentencePiece


@pytest.fixture(scope="module")
def both():
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(pieces.MODEL_PATH, "rb") as f:
        return pieces.PieceModel(f.read()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)


def test_pieces_of_documents_equal_the_library(both):
    ours, library = both
    texts = [r["text"] for r in table("documents")]
    assert [x.tolist() for x in ours.encode(texts)] == library.encode(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("the and   \n\t▁é.,0123 ABCqxz")), st.characters(codec="utf-8", exclude_characters="\0")), max_size=60), min_size=1, max_size=4))
def test_pieces_of_any_text_equal_the_library(both, texts):
    ours, library = both
    got = ours.encode(texts)
    assert [x.tolist() for x in got] == [library.encode(t) for t in texts]
    for t, ids in zip(texts, got, strict=True):
        assert ours.decode(ids.tolist()) == t.replace("▁", " ")


def test_long_runs_of_spaces(both):
    ours, library = both
    for n in [1, 2, 15, 16, 31, 47, 64, 65, 100, 333]:
        for text in (" " * n, "a" + " " * n + "b", " " * n + "\n" + " " * n + "the"):
            assert ours.encode([text])[0].tolist() == library.encode(text)


def test_unigram_model_takes_the_best_scored_segmentation():
    def message(fields):
        out = b""
        for number, kind, value in fields:
            out += bytes([number << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)
        return out

    scores = {"▁": -2.0, "a": -3.0, "b": -3.0, "c": -3.5, "ab": -4.0, "bc": -3.2, "▁a": -3.9, "abc": -9.0, "ca": -5.0}
    data = b"".join(message([(1, 2, message([(1, 2, p.encode()), (2, 5, np.float32(s).tobytes())]))]) for p, s in scores.items())
    data += message([(2, 2, message([(3, 0, b"\x01")])), (3, 2, message([(1, 2, b"identity"), (4, 0, b"\x00")]))])
    model = pieces.PieceModel(data)
    random.seed(2)
    words = sorted({"▁" + "".join(random.choice("abc") for _ in range(random.randint(0, 8))) for _ in range(200)})

    def best(word):
        if not word:
            return 0.0
        return max(s + best(word[len(p) :]) for p, s in scores.items() if word.startswith(p))

    for word, parts in model.search(words):
        assert "".join(parts) == word and sum(scores[p] for p in parts) == pytest.approx(best(word))


def test_pieces_edge_cases(spark, both):
    rows = pieces.encode(frame(spark, EDGE))
    by = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == len(EDGE) and by[1]["ids"] == [] and by[2]["n_tokens"] == 0 and all(r["round_trip"] for r in by.values())
    assert all(r["decoded_sha256"] == hashlib.sha256((dict((d, t) for d, t, _, _ in EDGE)[d] or "").encode()).hexdigest() for d, r in by.items())
    text = {r["doc_id"]: r["text"] for r in pieces.decode(rows).collect()}
    assert text[6] == EDGE[6][1] and text[3] == EDGE[2][1]
    assert pieces.encode(frame(spark, [])).collect() == []



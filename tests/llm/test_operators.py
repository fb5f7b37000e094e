"""Each operator against a brute-force version, on texts with every awkward case."""

import hashlib
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import bytesops, chat, classifier, decontaminate, fmindex, graph, langid, linededup, mphf, neardup, packing, quality_rules, substring, tokenfile, tokens
from corvane.llm import shared
from corvane.llm.shared import new_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made_texts():
    rng = np.random.default_rng(5)
    syllables = "the of in re an ti on er st ed é ñ ou ing ble ha ly".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    words = lambda n: [word() for _ in range(n)]
    passage = words(60)
    base = words(220)
    texts = [None, "", " \n\t ", "one", "Just four words here", "x" * 5000, "a " * 400, "\n".join(["same line of text here, repeated"] * 5), "été   naïve\x1f ΑΣ 日本 😀 <|endoftext|> <|ENDOFTEXT|> don't, I'd."]
    texts += [" ".join(words(80) + passage + words(30)), " ".join(words(10) + passage), " ".join(passage[:40] + words(20)), " ".join(base)]
    for n in (1, 2, 3, 8, 30):
        t = list(base)
        for i in rng.choice(len(t), n, replace=False):
            t[i] = word()
        texts.append(" ".join(t))
    texts += [" ".join(base).upper(), " ".join(base), " ".join(words(20000))]
    texts += ["\n".join(" ".join(words(30)) for _ in range(4)) for _ in range(4)]
    return texts


TEXTS = made_texts()
ROWS = [(i, t, f"src{i % 2}" if i % 5 else None, -1, "k") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[12], (None, "no id at all, but a text of its own", "src0", -1, "k")]
SCHEMA = "doc_id long, text string, source string, _id int, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_set(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def words_of(text):
    return WORD.findall(text or "")


def test_host_rules(spark, docs, none):
    got, hosts = quality_rules.apply_rules(docs)
    expected = Counter()
    for i, t, *_ in ROWS:
        t = t or ""
        w = words_of(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {j + k for j in range(len(w) - 2) for k in range(3) if c[tuple(w[j : j + 3])] > 1}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected[i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    assert as_set(got, "doc_id", *quality_rules.STATS, "base_failed") == expected
    assert got.filter("kept and base_failed").count() == 0
    assert {r["host"] for r in hosts.collect()} == {"src0", "src1"}
    assert quality_rules.apply_rules(none)[0].count() == 0


def test_host_verdicts_reach_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "fine") for i in range(50)] + [(100 + i, "short" if i % 10 else good, "bad") for i in range(50)] + [(200, "short", "new"), (201, good, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for rules in (quality_rules.Rules(), quality_rules.Rules(broadcast_hosts=0)):
        got, hosts = quality_rules.apply_rules(df, rules)
        kept = {r["doc_id"] for r in got.filter("kept").collect()}
        assert kept == {i for i, t, s in rows if t == good and s != "bad"}
        rate = {r["host"]: r["host_rate"] for r in hosts.collect()}
        assert 0.1 < rate["fine"] < rate["new"] < rate["bad"] < 0.9  # all drawn to the corpus rate


def brute_repeats(texts, span):
    seen = Counter(tuple(w[i : i + span]) for w in map(words_of, texts) for i in range(len(w) - span + 1))
    out = []
    for w in map(words_of, texts):
        gone = {i + k for i in range(len(w) - span + 1) if seen[tuple(w[i : i + span])] > 1 for k in range(span)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [substring.Settings(), substring.Settings(span=12, k=4, hot=1, shard_words=500)])
def test_substring_repeats(docs, none, settings):
    got = as_set(substring.remove_repeats(docs, settings), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter((r[0], *x) for r, x in zip(ROWS, brute_repeats([r[1] for r in ROWS], settings.span), strict=True))
    assert substring.remove_repeats(none).count() == 0


def test_a_text_that_repeats_itself(spark):
    """200,000 words of one phrase: every window repeats, and time is in proportion."""
    phrase = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(phrase * 5000)), (2, " ".join(["a"] * 3 + phrase[:36] + ["b"])), (3, "nothing of the kind")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (200000, 200000), 2: (40, 36), 3: (4, 0)}


def test_fm_index_against_counting():
    rng = np.random.default_rng(0)
    for _ in range(60):
        span = int(rng.integers(2, 6))
        texts = [rng.integers(1, 5, int(rng.integers(0, 20))).astype(np.uint64) for _ in range(int(rng.integers(1, 10)))]
        weight = rng.integers(1, 3, len(texts))
        count = Counter()
        for t, w in zip(texts, weight, strict=True):
            for i in range(len(t) - span + 1):
                count[tuple(t[i : i + span])] += w
        for t, found in zip(texts, fmindex.FMIndex(texts, weight).repeated(span), strict=True):
            windows = {i for a, b in found for i in range(a, b - span + 1)}
            assert windows == {i for i in range(len(t) - span + 1) if count[tuple(t[i : i + span])] > 1}


def items():
    w = ALNUM.findall(TEXTS[9].translate(LOWER))
    return [(1, " ".join(w[20:45])), (2, " ".join(w[20:45])), (3, "Four WORDS here"), (4, " ".join(w[100:115]) + " and something else entirely, of no document"), (5, None), (6, "?!"), (7, "never to be found in any of these texts, whatever their length may be"), (None, "one")]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_winnowing(spark, docs, none, block):
    bench = spark.createDataFrame(items(), "item_id int, text string")
    got = decontaminate.decontaminate(docs, bench, block_bytes=block)
    expected = Counter()
    for r in ROWS:
        w = ALNUM.findall((r[1] or "").translate(LOWER))
        hit, names = set(), set()
        for name, text in items():
            v = ALNUM.findall((text or "").translate(LOWER))
            n = min(len(v), 10)
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            at = [i for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in windows]
            hit |= {i + k for i in at for k in range(n)}
            names |= {str(name)} if at and name is not None else set()
        expected[r[0], len(w), len(hit), ",".join(sorted(names))] += 1
    hits = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    assert as_set(got, "doc_id", "_words", hits, F.array_join("_items", ",")) == expected
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter(F.size("_spans") > 0).count() == 0


def test_neighbour_quality(spark, docs, none):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    rows, marks = [], []
    for i in range(400):
        w = [word() for _ in range(int(rng.integers(20, 80)))]
        bad = i % 4 == 0
        rows.append((i, " | ".join(w) if bad else " ".join(w) + "."))
        marks.append((i, int(not bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    held = classifier.fold(F.col("doc_id"), 5) == 0
    model = classifier.fit(df, labels.filter(~held), classifier.Settings(max_per_class=60))
    got = {r["doc_id"]: r["score"] for r in classifier.score(df, model).collect()}
    test = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(i % 4) for i in test) > 0.95 * len(test)
    scored = classifier.score(docs.withColumn("score", F.lit("old")), model)
    assert scored.columns == [*docs.columns, "score"] and scored.count() == len(ROWS)
    # Every score is the vote of the exact cosines with all labelled vectors; empty texts are scored like any other.
    texts = [t or "" for _, t, *_ in ROWS if t is None or len(t) < 20000] + [t for _, t in rows]
    x = classifier.features(*bytesops.raw(pa.array(texts)))
    assert all((classifier.features(*bytesops.raw(pa.array([t]))) == x[i]).all() for i, t in enumerate(texts) if i % 40 == 0)
    for i, v in enumerate(model.predict(x)):
        z = (x[i] * model.scale - model.mean).astype(float) @ model.basis.astype(float)
        cos = [float(z @ k) / max(np.linalg.norm(z), 1e-9) for k in model.known.astype(float)]
        near = sorted(range(len(cos)), key=lambda j: -cos[j])[: model.s.neighbours]
        w = [max(cos[j], 1e-3) ** model.s.sharpness * model.vote[j] for j in near]
        assert abs(v - sum(a * model.label[j] for a, j in zip(w, near, strict=True)) / sum(w)) < 1e-3, texts[i][:40]
    empty = {r["score"] for r in scored.filter("text is null or text = ''").select("score").collect()}
    assert len(empty) == 1
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0
    assert classifier.score(none, model).count() == 0
    unlearnt = classifier.fit(df, labels.limit(0))
    assert classifier.score(df, unlearnt).select("score").distinct().collect()[0][0] == 0.5


def test_language_profiles(spark, docs, none):
    rng = np.random.default_rng(2)
    made = {"xx": "bababa dede fofo gugu", "yy": "zyxa qowi xuza wyqo", "éé": "çaté ñoñé éça téñ"}
    rows = [(i, " ".join(rng.choice(made[n].split(), 30)), n) for i, n in enumerate(list(made) * 20)] + [(90, "", "xx"), (91, None, "xx"), (92, "12 34!", "yy"), (93, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(df.filter("doc_id % 4 <> 2 or doc_id >= 90"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, profiles).collect()}
    assert all(got[i][0] == n for i, _, n in rows if i < 90)
    assert all(got[i] == ("und", 0.0) for i in (90, 91, 92)) and got[93][0] in made
    assert langid.identify(none, profiles).count() == 0
    nobody = langid.learn(df.limit(0))
    assert {r[0] for r in langid.identify(docs, nobody).select("lang_pred").distinct().collect()} == {"und"}
    # A text's vector is the sum of its bound trigrams.
    doc, number, keys, letters = langid.trigrams(pa.array(["Abc", "ab1!c", ""]))
    assert letters.tolist() == [3, 3, 0]
    v = langid.gram_vectors(keys)
    one = [langid.letter_vector(ord(c)) for c in "abc"]
    assert (v[number[0]] == np.roll(one[0], 2) * np.roll(one[1], 1) * one[2]).all()


def brute_language_vector(text):
    """The bundle of bound trigrams, letter by letter."""
    letters = [" "]
    for c in text:
        if c.isalpha():
            letters.append(c.lower() if len(c.lower()) == 1 else c)
        elif letters[-1] != " ":
            letters.append(" ")
    letters = letters[1:] if text and text[0].isalpha() else letters
    v = np.zeros(langid.DIMS)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        x, y, z = (langid.letter_vector(0 if q == " " else ord(q)).astype(float) for q in (a, b, c))
        v += np.roll(x, 2) * np.roll(y, 1) * z
    return v, max(len(letters) - 2, 0), any(c != " " for c in letters)


@pytest.mark.parametrize("keys", [langid.KEYS, 7])
def test_language_cosines_against_brute_force(spark, monkeypatch, keys):
    monkeypatch.setattr(langid, "KEYS", keys)
    rng = np.random.default_rng(11)
    letters = {"aa": "abcdeé ", "bb": "cdefgß- ", "cc": "日本語中文 "}
    rows = [("".join(rng.choice(list(letters[n]), int(rng.integers(1, 60)))), n) for n in list(letters) * 12] + [("", "aa"), ("x", "bb"), ("1 2 3", "cc"), ("aa bb", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    profiles = langid.learn(df)
    made = {}
    for text, n in rows:
        v, count, _ = brute_language_vector(text)
        if n is not None:
            made[n] = made.get(n, 0) + v / max(count, 1)
    assert profiles.names == sorted(made)
    for n, u in zip(profiles.names, profiles.unit, strict=True):
        assert np.abs(u - made[n] / np.linalg.norm(made[n])).max() < 1e-5
    names, score = profiles.predict(pa.array([t for t, _ in rows]))
    for (text, _), name, got in zip(rows, names, score, strict=True):
        v, _, some = brute_language_vector(text)
        if not some:
            assert (name, got) == ("und", 0.0)
            continue
        cos = {n: float(v @ made[n]) / max(np.linalg.norm(v) * np.linalg.norm(made[n]), 1e-9) for n in made}
        best = max(cos.values())
        assert abs(got - min(max(best, 0), 1)) < 1e-4 and cos[name] > best - 1e-4


def test_languages_are_limited(spark):
    df = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(5)], "text string, lang string")
    with pytest.raises(ValueError):
        langid.learn(df, max_languages=4)
    assert len(langid.learn(df, max_languages=5).names) == 5


def test_language_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("same words here", n) for n in ("zz", "mm", "aa")], "text string, lang string")
    assert langid.learn(df).predict(pa.array(["same words"]))[0] == ["aa"]


def shingles(text, k=5):
    w = words_of((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_components(rows, percent):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], len(sets[i]), least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates(docs, none, block):
    got = neardup.near_duplicates(docs, neardup.Settings(block=block))
    assert as_set(got, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute_components(ROWS, 85))
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_that_link_in_chains(spark):
    """Every text differs from the next in one word; only neighbours are linked directly."""
    rng = np.random.default_rng(3)
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(w)))
        w[int(rng.integers(len(w)))] = f"n{i}"
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    got = neardup.near_duplicates(df, neardup.Settings(block=8))
    assert as_set(got, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute_components([(int(i), t) for i, t in rows], 85))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200}


def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in ROWS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    encoder, whole = tokens.Encoder.get(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert encoder.fast
    parts = ["a", "B", "é", "É", "J̌", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "DON'T", ",", ".", "...", "a.b,c", "1.5", "\x1c", " ", " ", "\n", "İ", "ß", "ΑΣ.", "日本", "😀", "\x00", "ñ.", "—.", "̸", "ÀÉ×"]
    rng = np.random.default_rng(4)
    texts = ["".join(str(rng.choice(parts)) + " " * int(rng.random() < 0.3) for _ in range(rng.integers(0, 12))) for _ in range(900)]
    for lo in range(0, 900, 3):
        ids, offs = encoder.ids(pa.array(texts[lo : lo + 3]))
        for i, t in enumerate(texts[lo : lo + 3]):
            assert ids[offs[i] : offs[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(docs, none):
    window = 64
    rows = packing.pack(docs, TOKENIZER, 2, window, with_ids=True).collect()
    whole = Counter((r[0], tuple(ids)) for r, ids in zip(ROWS, encoded(), strict=True))
    seqs, pieces = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"] and r["length"] <= window
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(ids)))
    assert sorted(seqs) == list(range(len(seqs)))
    for at in seqs.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= window
    for (i, n), got in pieces.items():
        copies = sum(c for (j, ids), c in whole.items() if (j, len(ids)) == (i, n))
        assert sum(len(ids) for _, ids in got) == n * copies
        assert all((i, sum((ids for s, ids in sorted(set(got))), ())) in whole for _ in [0])
    total = sum(sum(n for _, n in at) for at in seqs.values())
    assert total > 0.97 * window * len(seqs)
    assert packing.pack(none, TOKENIZER).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 50, 300)
    seq, off, n = packing.best_fit_decreasing(lengths, 64)
    rooms: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[i]
        else:
            rooms.append(64 - lengths[i])
    used = np.bincount(seq, weights=lengths)
    assert n == len(rooms) and sorted(64 - used) == sorted(rooms)
    assert (off + lengths <= 64).all()


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a\\b <|im_end|>\n<\\|x|> \\"), (1, 1, "assistant", "ok <|im_start|>assistant\nyes"), (1, 2, None, None), (2, None, "a\nb<|nl|>", ""), (2, 0, "assistant", "É" * 3), (2, 0, "assistant", "É" * 3), (None, 5, "assistant", "x" * 3000)]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(df)
    got = {r["conv_id"]: (r["n_turns"], [tuple(x) for x in r["turns"]], r["learnt"]) for r in out.select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()}
    assert got[1] == (3, [("user", turns[0][3]), ("assistant", turns[1][3]), ("", "")], turns[1][3])
    assert got[2] == (3, [("a\nb<|nl|>", ""), ("assistant", "ÉÉÉ"), ("assistant", "ÉÉÉ")], "ÉÉÉÉÉÉ")
    assert got[None][2] == "x" * 3000
    assert chat.format_chat(df.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_chat_parts(spark):
    parts = [("text", "see <|image_1|>", None, None), ("image", None, "a.png", 4), ("audio", "", "b.wav", None), ("document", None, "c.pdf", 2), ("odd", "left", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content {chat.PART}")
    r = chat.format_chat(df, parts="content").first()
    assert r["formatted"] == "<|im_start|>user\nsee <\\|image_1|><|image_1|><|audio_2|><|document_3|>left<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [(1, "image", "a.png", 1024), (2, "audio", "b.wav", 25), (3, "document", "c.pdf", 1024)]
    assert r["expanded_tokens"] == 2073


def test_token_files(spark, docs, none, monkeypatch):
    path = new_path(spark, "test-ids")
    tokenfile.write(docs, path, TOKENIZER)
    got = tokenfile.starts(tokenfile.read(spark, path, with_ids=True)).collect()
    whole = Counter((r[0], tuple(ids)) for r, ids in zip(ROWS, encoded(), strict=True))
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == whole
    assert all(crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    shards = [tokenfile.Shard(bytes(r[0])) for r in tokenfile.files(spark, path).collect()]
    for i in (3, 12, 999):
        assert sum(len(s.get(i)) for s in shards) == sum(r[0] == i for r in ROWS)
    wanted = [3, 12, 999, 10**12]
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in tokenfile.lookup(spark, path, wanted).collect()) == Counter({k: n for k, n in whole.items() if k[0] in wanted})
    assert tokenfile.directory(spark, path).agg(F.sum("docs")).first()[0] == len(ROWS)
    assert tokenfile.lookup(spark, path, [10**12]).count() == 0 and tokenfile.lookup(spark, path, []).count() == 0
    empty = new_path(spark, "test-ids")
    tokenfile.write(none, empty, TOKENIZER)
    assert tokenfile.lookup(spark, empty, wanted).count() == 0
    assert tokenfile.starts(tokenfile.read(spark, empty)).count() == 0


def test_minimal_perfect_hash():
    keys = np.random.default_rng(7).integers(0, 1 << 63, 20000, dtype=np.int64).view(np.uint64)
    sizes, words = mphf.build(keys)
    slots = mphf.slots(keys, sizes, words, mphf.ranks(words))
    assert sorted(slots.tolist()) == list(range(20000))
    assert mphf.build(keys[:0])[0] == []


def brute_lines(rows, s):
    lines = []
    for i, t, *_ in rows:
        for pos, x in enumerate((t or "").split("\n")):
            if len(x.encode()) >= s.min_chars:
                n = b" ".join(x.encode().lower().split())
                if sum(bytesops.ALNUM[b] and (b < 0x80 or b >= 0xC0) for b in n) >= s.min_chars:
                    u = n.decode()
                    lines.append(((i if i is not None else -1), pos, frozenset(u[j : j + s.k] for j in range(max(1, len(u) - s.k + 1)))))
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][2], lines[j][2]
            if 100 * len(a & b) >= s.percent * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for k, (i, pos, _) in enumerate(lines):
        first[find(k)] = min((i, pos), first.get(find(k), (i, pos)))
    return {(i, pos) for k, (i, pos, _) in enumerate(lines) if (i, pos) != first[find(k)]}


def test_fuzzy_lines(spark, none):
    rng = np.random.default_rng(8)
    line = lambda: " ".join("".join(rng.choice(list("abcdefghijk"), 6)) for _ in range(15))
    pool = [line() for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short\nshort\nshort")]
    for i in range(3, 23):
        some = [pool[int(rng.integers(6))] for _ in range(3)] + [line()]
        rows.append((i, "\n".join(x if rng.random() < 0.5 else x.replace(x[10:13], "zzz", 1) for x in some)))
    rows.append((30, rows[5][1].upper() + "\n\n" + pool[0]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = linededup.Settings()
    got = linededup.dedup_lines(df, s).collect()
    assert {(r["doc_id"], p) for r in got for p in r["_removed"]} == brute_lines(rows, s)
    for r in got:
        if r["text"]:
            assert r["_kept_text"] == "\n".join(x for p, x in enumerate(r["text"].split("\n")) if p not in r["_removed"])
    assert linededup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("more", [{}, {"block": 16}, {"block_bytes": 50_000}])
def test_fuzzy_lines_in_hot_buckets(spark, more):
    """Lines of one template, at Jaccard 0.76 to each other, fill the buckets; 30 pairs among them are at 0.84."""
    rng = np.random.default_rng(12)
    base = rng.choice(list("abcdefghijk"), 3000)

    def edited(places):
        x = base.copy()
        x[places] = rng.choice(list("lmnopqrstuvwxyz"), len(places))
        return x

    lines = [edited(rng.choice(3000, 26, replace=False)) for _ in range(100)]
    for _ in range(30):
        both = edited(rng.choice(3000, 17, replace=False))
        for _ in range(2):
            one, own = both.copy(), rng.choice(3000, 9, replace=False)
            one[own] = rng.choice(list("lmnopqrstuvwxyz"), 9)
            lines.append(one)
    rows = [(int(i), "".join(lines[n])) for i, n in enumerate(rng.permutation(len(lines)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = brute_lines(rows, linededup.Settings())
    assert len(gone) == 30
    assert {(r["doc_id"], p) for r in linededup.dedup_lines(df, linededup.Settings(**more)).collect() for p in r["_removed"]} == gone


def gram_lines(rows, s):
    """What brute_lines says of texts of one line each, by one product of all their sets."""
    sets = [sorted({t[j : j + s.k] for j in range(len(t) - s.k + 1)}) for _, t in rows]
    number = {x: k for k, x in enumerate(sorted({x for u in sets for x in u}))}
    both, size = np.zeros((len(rows), len(rows)), np.float32), np.array([len(u) for u in sets])
    at = [np.array([number[x] for x in u]) for u in sets]
    for lo in range(0, len(number), 8192):
        table = np.zeros((len(rows), 8192), np.float32)
        for i, x in enumerate(at):
            table[i, x[(x >= lo) & (x < lo + 8192)] - lo] = 1
        both += table @ table.T
    x, y = np.nonzero(100 * both >= s.percent * (size[:, None] + size - both))
    root = graph.contract(x, y, len(rows))
    first = {}
    for (i, _), r in zip(rows, root.tolist(), strict=True):
        first[r] = min(i, first.get(r, i))
    return {i for (i, _), r in zip(rows, root.tolist(), strict=True) if first[r] != i}


def test_winnowing_of_repeated_words():
    """A word repeated a million times against items of one word repeated, and pairs of words."""
    index = decontaminate.Index([("a", "a " * 1000), ("z", "0 " * 12), ("ab", "a b " * 500), ("short", "a a a")])
    texts = ["a " * 1_000_000, "a b " * 300_000, "0 " * 9, "x " + "0 " * 10 + "y", "b a " * 5 + "a a"]
    began = time.perf_counter()
    got = [(words, spans, sorted(index.names[i][0] for i in items)) for _, words, spans, items in decontaminate.scan(pa.array(texts), index)]
    assert got == [
        (1_000_000, [(0, 1_000_000)], ["a", "short"]),
        (600_000, [(0, 600_000)], ["ab"]),
        (9, [], []),
        (12, [(1, 11)], ["z"]),
        (12, [(0, 12)], ["ab", "short"]),
    ]
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("more", [{}, {"local": 2, "held": 256}])
def test_fuzzy_lines_of_a_template(spark, more):
    """2,400 lines of one template at Jaccard 0.7 to each other, 200 pairs and a family of 100 among them; every line in two tasks."""
    rng = np.random.default_rng(13)
    base = rng.choice(list("abcdefghijk"), 400)

    def edited(x, n):
        x = x.copy()
        x[rng.choice(400, n, replace=False)] = rng.choice(list("lmnopqrstuvwxyz"), n)
        return x

    lines = [edited(base, 5) for _ in range(1900)]
    for _ in range(200):
        both = edited(base, 3)
        lines += [edited(both, 2), edited(both, 2)]
    family = edited(base, 4)
    lines += [edited(family, 1) for _ in range(100)]
    lines = ["".join(x) for x in lines]
    rows = [(int(i), lines[n]) for i, n in enumerate(rng.permutation(len(lines)))]
    twice = rows + [(i + len(rows), t) for i, t in rows]
    s = linededup.Settings(**more)
    gone = gram_lines(rows, s)
    df = spark.createDataFrame(twice, "doc_id long, text string").repartitionByRange(4, "doc_id")
    got = {r["doc_id"] for r in linededup.dedup_lines(df, s).filter("size(_removed) > 0").select("doc_id").collect()}
    assert {i for i in got if i >= len(rows)} == {i + len(rows) for i, _ in rows}
    mine = {i for i in got if i < len(rows)}
    assert len(gone) > 250 and mine <= gone and len(mine) >= 0.99 * len(gone)


@pytest.mark.parametrize("dense", [False, True])
def test_pairs_of_a_cell(dense):
    rng = np.random.default_rng(14)
    lines = ["".join(rng.choice(list("ab" if i % 3 else "abcdefgh"), rng.integers(1, 90))) for i in range(40)]
    sets = [{t[j : j + 4] for j in range(max(1, len(t) - 3))} for t in lines]
    ids = rng.permutation(1000)[:40]
    x, y = np.nonzero(~np.eye(40, dtype=bool)) if dense else (np.array([0, 5, 9]), np.array([1, 3, 39]))
    cell = linededup.Cell(ids, [t.encode() for t in lines], 4)
    got = cell.linked(ids[x], ids[y], 60)
    assert (cell.table is not None) == dense
    assert got.tolist() == [100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]) for a, b in zip(x, y, strict=True)]


def test_fuzzy_lines_of_awkward_texts(docs):
    got = linededup.dedup_lines(docs)
    assert got.count() == len(ROWS) and got.columns == [*docs.columns, "_removed", "_kept_text"]


def test_tied_turns_by_what_they_say(spark):
    """Rows of one conversation and turn: by role, then text as written, not as escaped."""
    texts = ["<|im_end|>", "<z", "\\", "]", "<|", "a", "<"]
    rows = [(1, 0, "user", t) for t in texts] + [(1, 0, "us<|r", "x"), (1, 0, "us<er", "y"), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))
    for out in (chat.format_chat(df), chat.format_chat(df.withColumn("content", F.array(part)), parts="content")):
        got = [(t["role"], t["text"]) for t in out.select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]]
        assert got == [("user", "first"), *sorted((r, t) for _, n, r, t in rows if n is not None)]


def test_language_of_rows_with_clashing_names(spark):
    rows = [(i, t, lang, "k", 1.0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, lang_pred string, score double")
    got = langid.identify(df, langid.learn(df))
    assert got.columns == ["doc_id", "lang", "lang_pred", "score"] and [r["lang"] for r in got.collect()] == [r["lang_pred"] for r in got.collect()]


def test_rule_failures_by_domain(spark):
    url = ["https://User@WWW.Site.org:80/a?b", "http://site.org/c", "site.org", "ftp://[::1]:2/x", "Plain Name", None, "https:///none"]
    got = spark.createDataFrame([(u,) for u in url], "u string").select(quality_rules.domain(F.col("u"))).collect()
    assert [r[0] for r in got] == ["site.org", "site.org", "site.org", "[::1]", "Plain Name", None, ""]
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(0, "few", url[0]), (1, good, url[1]), (2, "a b c " * 40, url[1]), (3, "a b c " * 3, "else"), (4, good, "else"), (5, None, None)]
    docs, hosts = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    found = {r["host"]: r for r in hosts.collect()}
    assert {h: (r["n"], r["f"], r["f_few_words"], r["f_repeats"]) for h, r in found.items()} == {"site.org": (3, 2, 1, 1), "else": (2, 1, 1, 1)}
    assert all(0 < r[c] < 1 for r in found.values() for c in ("host_rate", "rate_few_words", "rate_repeats"))
    assert docs.count() == 6


def test_a_scope_deletes_what_was_staged_within(spark):
    before = shared.stage(spark.range(3), "outer")
    with shared.scope(spark):
        inner = shared.stage(spark.range(4), "inner")
        path = inner.inputFiles()[0]
        assert inner.count() == 4
    assert before.count() == 3 and not os.path.exists(path.removeprefix("file://"))

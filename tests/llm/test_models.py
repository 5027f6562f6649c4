"""The learned operators and the URL filters: brute-force probabilities, held-out accuracy, exact membership."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest
from corpus import SCHEMA, frame, held_out, lower, rows, words
from pyspark.sql import functions as F

from terrafold.llm import kneser_ney, language_id, url_filters


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


class BruteForceModel:
    def __init__(self, texts):
        sequences = [[*words(lower(t)), None] for t in texts]
        self.words = Counter(w for s in sequences for w in s)
        self.pairs = Counter(p for s in sequences for p in zip(["<start>", *s], s, strict=False))
        self.before = Counter(w for _, w in self.pairs)
        self.after = defaultdict(list)
        for (v, _), c in self.pairs.items():
            self.after[v].append(c)
        of = lambda counts: kneser_ney.discounts(*(sum(c == i for c in counts) for i in (1, 2, 3, 4)))
        self.upper, self.lower = of(self.pairs.values()), of(self.before.values())

    def d(self, c, discounts):
        return 0.0 if not c else discounts[min(c, 3) - 1]

    def q(self, w):
        if not self.pairs:
            return 1.0 / (len(self.words) + 1)
        k = self.before[w]
        rest = sum(self.d(c, self.lower) for c in self.before.values())
        return max(k - self.d(k, self.lower), 0) / len(self.pairs) + rest / len(self.pairs) / (len(self.words) + 1)

    def p(self, v, w):
        if v not in self.after:
            return self.q(w)
        c, total = self.pairs[v, w], sum(self.after[v])
        return max(c - self.d(c, self.upper), 0) / total + sum(self.d(x, self.upper) for x in self.after[v]) / total * self.q(w)

    def score(self, text):
        s = [*words(lower(text)), None]
        return sum(math.log10(self.p(v, w)) for v, w in zip(["<start>", *s], s, strict=False))


@pytest.mark.parametrize("shard_words,shard_tokens,buffer", [(2_000_000, 4_000_000, 3_000_000), (20, 200, 150)])
def test_kneser_ney(spark, monkeypatch, shard_words, shard_tokens, buffer):
    """Whole and in many shards; null and empty texts, unknown words and a very long text included."""
    monkeypatch.setattr(kneser_ney, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(kneser_ney, "BUFFER", buffer)
    data = [*rows(), (997, "unheard of words only", "en", "s", 1)]
    docs = frame(spark, data).withColumn("hash", F.lit(1)).withColumn("count", F.lit(2)).withColumn("shard", F.lit(3))
    got = collected(kneser_ney.scored(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2))
    model = BruteForceModel([t for d, t, *_ in data if not held_out(d, 7)])
    n, v = sum(model.words.values()), len(model.words)
    for d, t, *_ in data:
        tokens = [*words(lower(t)), None]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(d, 7), len(tokens), sum(model.words[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.words[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert r["score"] == pytest.approx(model.score(t), rel=1e-9), d


def test_kneser_ney_deals_hot_words_out(tmp_path, monkeypatch):
    """Words that occur often are in shards by their second word, and give the same scores; a file that is missing is an error."""
    import pyarrow as pa

    monkeypatch.setattr(kneser_ney, "HOT", 5)
    texts = [t for _, t, *_ in rows() if t] + ["the the the end"] * 12
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    hashes = np.unique(np.concatenate([kneser_ney.tokens_of(data, offsets)[0] for _, _, data, offsets in kneser_ney.slices(batch.column(0))]), return_counts=True)
    folder, size = str(tmp_path), len(hashes[0])
    kneser_ney.write_words(pa.table({"shard": [0] * size, "hash": hashes[0].view(np.int64), "count": hashes[1]}), folder)
    hot = {i: int(n) for i, n in enumerate(hashes[1]) if n > 5} | {size: len(texts)}
    model = {"folder": folder, "bits": 0, "bases": [0], "size": size, "tokens": int(hashes[1].sum()), "shards": 3, "ranges": 12, "hot": hot}
    grouped = lambda t: [t.filter(pa.compute.equal(t["shard"], s)) for s in t["shard"].unique().to_pylist()]
    pairs = pa.Table.from_batches(list(kneser_ney.bigram_rows([batch], model)))
    assert sum(s.as_py() & ((1 << 24) - 1) > 0 for s in pairs["shard"].unique()) > 5
    out = pa.concat_tables([kneser_ney.write_bigrams(t, model) for t in grouped(pairs)])
    facts = [kneser_ney.json.loads(x.as_py()) for x in out.filter(pa.compute.less(out["shard"], 0))["keys"]]
    low = pa.concat_tables([kneser_ney.write_continuations(t, model) for t in grouped(out.filter(pa.compute.greater_equal(out["shard"], 0)))])
    upper, lower = np.sum([x["counts"] for x in facts], axis=0).tolist(), [sum(low[f"n{i}"].to_pylist()) for i in range(1, 6)]
    stats = {v: np.zeros(4) for v in hot}
    for x in facts:
        for v, s in x["hot"].items():
            stats[int(v)] += s
    model |= {"bigrams": upper[4], "upper": kneser_ney.discounts(*upper[:4]), "lower": kneser_ney.discounts(*lower[:4]), "present": [x["shard"] for x in facts], "parts": low["part"].to_pylist(), "statistics": stats}
    model["rest"] = sum(d * n for d, n in zip(model["lower"], (lower[0], lower[1], lower[4]), strict=True)) / upper[4]
    brute = BruteForceModel(texts)
    asked = ["the the unheard end", *texts[:20]]
    [scored] = [x for data in [pa.RecordBatch.from_arrays([pa.array(range(21)), pa.array([False] * 21), pa.array(asked)], names=["a", "b", "c"])] for x in kneser_ney.score_rows([data], model)]
    assert scored.column(6).to_pylist() == pytest.approx([brute.score(t) for t in asked], rel=1e-9)
    next(tmp_path.glob("bigrams-*.npy")).unlink()
    with pytest.raises(FileNotFoundError):
        kneser_ney.Model(model)


def test_kneser_ney_probabilities_sum_to_one():
    model = BruteForceModel([t for _, t, *_ in rows()])
    for v in list(model.after)[:5]:
        assert sum(model.p(v, w) for w in [*model.words, "<unknown>"]) == pytest.approx(1.0)


def test_kneser_ney_without_training(spark):
    got = kneser_ney.scored(frame(spark, rows()[:5]), F.lit(True)).collect()
    assert len(got) == 5 and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in got)
    assert kneser_ney.scored(frame(spark, []), F.lit(False)).count() == 0


def language_rows(n=300):
    rng = np.random.default_rng(3)
    syllables = {"aa": ["th", "ing", "er", "and", "wh"], "bb": ["sch", "ein", "ung", "keit", "ü"], "cc": ["eau", "é", "ment", "tion", "oi"]}
    made = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        text = " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(int(rng.integers(5, 60))))
        made.append((i, text, lang if i % 11 else None, "s", 1))
    return [*made, (9001, None, "aa", "s", 0), (9002, "", "aa", "s", 0), (9003, "12 34 --", "bb", "s", 0), (9004, "THE " + "thing " * 5000, "aa", "s", 0)]


def test_language_id(spark):
    data = language_rows()
    docs = frame(spark, data).withColumn("label", F.lit("x")).withColumn("key", F.lit("x")).withColumn("shard", F.lit(0))
    got = collected(language_id.identified(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2))
    truth = {d: ("aa", "bb", "cc")[d % 3] for d, *_ in data if d < 9000}
    out = [d for d in truth if held_out(d, 4)]
    assert all(got[d]["held_out"] for d in out)
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[d]["lang_pred"] for d in (9001, 9002, 9003)} == {"und"} and got[9004]["lang_pred"] == "aa"


def plain_features(text, bits):
    """Counts of the hashed 1- to 3-grams, one character at a time."""
    chars = [32 if ord(c) < 33 else ord(c) + 32 if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else ord(c) for c in text]
    factors, whole, out = [int(x) for x in language_id._FACTORS], (1 << 64) - 1, Counter()
    for i in range(len(chars)):
        h = 0
        for n in range(min(3, len(chars) - i)):
            h = (h + chars[i + n] + 1) * factors[n] & whole
            out[((h ^ (h >> 29)) * factors[0] & whole) >> (64 - bits)] += 1
    return out


def plain_tf_idf(text, df, total, bits):
    found = plain_features(text, bits)
    raw = {f: math.log1p(c) * (math.log((1 + total) / (1 + df[f])) + 1) for f, c in found.items()}
    norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
    return {f: v / norm for f, v in raw.items()}


@pytest.mark.parametrize("bits", [15, 8])
def test_leader_against_brute_force(monkeypatch, bits):
    """Features, tf-idf and the weights after follow-the-regularised-leader, coordinate by coordinate."""
    import pyarrow as pa

    labels = ["aa", "bb", "cc"]
    monkeypatch.setattr(language_id, "CELLS", 3 << bits)
    rows_ = [(t, x) for _, t, x, *_ in language_rows(45) if t and x]
    texts = [t for t, _ in rows_]
    df = Counter(f for t in texts for f in plain_features(t, bits))
    idf = np.array([math.log((1 + len(texts)) / (1 + df[f])) + 1 for f in range(1 << bits)])
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    [counted] = language_id.frequency_rows([batch], bits)
    assert dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist(), strict=True)) == {**df, -1: len(texts)}
    order = [(i * 7) % len(texts) for i in range(len(texts))]
    got = language_id.leader(pa.table({"text": texts, "label": [x for _, x in rows_], "order": order}), labels, idf)
    z, n = defaultdict(lambda: [0.0] * 3), defaultdict(lambda: [0.0] * 3)
    a, b, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2

    def weight(f, k):
        return 0.0 if abs(z[f][k]) <= l1 else (math.copysign(l1, z[f][k]) - z[f][k]) / ((b + math.sqrt(n[f][k])) / a + l2)

    for _ in range(language_id.EPOCHS):
        for i in sorted(range(len(texts)), key=lambda i: order[i]):
            x = plain_tf_idf(texts[i], df, len(texts), bits)
            w = {f: [weight(f, k) for k in range(3)] for f in x}
            e = np.exp([sum(x[f] * w[f][k] for f in x) for k in range(3)])
            p = e / e.sum()
            for f, v in x.items():
                for k in range(3):
                    g = v * (p[k] - (labels[k] == rows_[i][1]))
                    z[f][k] += g - (math.sqrt(n[f][k] + g * g) - math.sqrt(n[f][k])) / a * w[f][k]
                    n[f][k] += g * g
    want = {(f, k): weight(f, k) for f in z for k in range(3) if weight(f, k)}
    found = {(r["feature"], r["label"]): r["weight"] for r in got.to_pylist()}
    assert found.keys() == want.keys() and all(found[x] == pytest.approx(want[x], rel=1e-6, abs=1e-9) for x in want)


def test_language_id_with_many_labels(spark, monkeypatch):
    """More labels than full-width features have room for: all are learned, over fewer features."""
    monkeypatch.setattr(language_id, "CELLS", 1 << 14)
    data = [(i, " ".join([f"{chr(97 + i % 20)}{chr(98 + i % 19)}{chr(99 + i % 17)}"] * 12), f"l{i % 20:02}", "s", 0) for i in range(400)]
    got = collected(language_id.identified(frame(spark, data), F.lit(False)))
    assert language_id.bits_for(20) == 9 and {r["lang_pred"] for r in got.values()} == {f"l{i:02}" for i in range(20)}


def test_language_id_ignores_labels_of_held_out_rows(spark):
    data = language_rows()
    blind = [(d, t, None if held_out(d, 4) else lang, "other", 0) for d, t, lang, *_ in data]
    run = lambda x: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identified(frame(spark, x), F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()}
    assert run(data) == run(blind)


def test_language_id_without_labels(spark):
    got = language_id.identified(frame(spark, [(1, "some text", None, "s", 0)]), F.lit(False)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert language_id.identified(frame(spark, []), F.lit(False)).count() == 0


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = language_id.softmax(logits)
    target = np.array([rng.choice(3, p=x) for x in p])
    assert language_id.temperature(logits * 5, target) == pytest.approx(5, rel=0.15)


URLS = [
    "http://a.com/x?q", "https://EXAMPLE.com/en/1", "https://www.example.com/en/2#f", "http://x.www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/es",
    "http://com", "x.com/en/", None, "", "http:///en/", "http://www.example.com?/en/", "ftp://a.b.c.example.com/en/x", "http://a.org/en/", "http://x.net/de/", "http://a..com/",
]


def expected(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = lower(rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("part_keys", [url_filters.PART_KEYS, 1])
def test_url_filters(spark, part_keys):
    """In one part, and with a list dealt into parts of about one key."""
    odd = [*URLS, "http://x.example.com/en/" + "y" * 20_000, URLS[1]]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(odd)], "page_id long, url string, host int, rule int")
    found = url_filters.judged(pages, url_filters.rule_table(spark), keep=["page_id"], part_keys=part_keys)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {i: expected(u, url_filters.RULES) for i, u in enumerate(odd)}


def test_url_filters_give_the_same_in_parts_of_a_long_list(spark):
    """Many path lengths and parts: the longest key wins, whichever part has it."""
    rules = [("block" if i % 3 else "allow", f"h{i % 40}.test", "/" + "p" * (i % 60)) for i in range(500)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    pages = spark.createDataFrame([(i, f"http://www.h{i % 45}.test/" + "p" * (i % 70)) for i in range(400)], "page_id long, url string")
    for part_keys in (url_filters.PART_KEYS, 60):
        found = url_filters.judged(pages, url_filters.rule_table(spark, rules), keep=["page_id"], part_keys=part_keys).collect()
        assert {r["page_id"]: (r["rule"], r["verdict"]) for r in found} == {i: expected(f"http://www.h{i % 45}.test/" + "p" * (i % 70), rules)[2:] for i in range(400)}


def test_url_filters_with_many_rules(spark):
    rules = [("block", f"h{i}.test", "/") for i in range(0, 300, 2)] + [("allow", f"h{i}.test", "/ok") for i in range(0, 300, 4)]
    urls = [f"http://{s}h{i}.test/{p}" for i in range(300) for s in ("", "www.") for p in ("ok", "no")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judged(pages, url_filters.rule_table(spark, rules), keep=["page_id"]).collect()}
    assert got == {i: expected(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(0, 2000, 7).select(F.lit("block").alias("verdict"), F.col("id").cast("string").alias("key"))
    universe = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    levels = url_filters.cascades_of(keys, universe, 2000)["block"]
    assert len(levels) > 1
    got = universe.select("key", url_filters.listed(F.col("key"), levels).alias("listed")).collect()
    assert all(r["listed"] == (int(r["key"]) % 7 == 0) for r in got)


def test_url_filters_on_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judged(none, url_filters.rule_table(spark), keep=["page_id"]).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filters.judged(some, url_filters.rule_table(spark).limit(0), keep=["page_id"]).collect()] == ["allow"]


def test_schema_of_the_small_corpora():
    assert len(rows()[0]) == len(SCHEMA.split(","))


def test_kneser_ney_with_few_open_files(spark, monkeypatch):
    """Hundreds of shards and at most six of them mapped at once: equal scores, and no more descriptors than that."""
    monkeypatch.setattr(kneser_ney, "SHARD_WORDS", 2)
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 20)
    monkeypatch.setattr(kneser_ney, "BUFFER", 150)
    docs = frame(spark, rows())
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    whole = sorted((r["doc_id"], r["score"]) for r in kneser_ney.scored(docs, held).collect())
    monkeypatch.setattr(kneser_ney, "OPEN", 6)
    few = sorted((r["doc_id"], r["score"]) for r in kneser_ney.scored(docs, held).collect())
    assert few == whole


def test_a_shelf_closes_what_is_longest_unused(tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(kneser_ney, "OPEN", 6)
    for i in range(200):
        kneser_ney.save_array(str(tmp_path), f"words-{i}", np.arange(i + 1))
    shelf, before = kneser_ney.Shelf(str(tmp_path)), len(os.listdir("/proc/self/fd"))
    assert [int(shelf.array(f"words-{i % 200}", np.int64)[-1]) for i in range(400)] == [i % 200 for i in range(400)]
    assert len(os.listdir("/proc/self/fd")) <= before + 7
    with pytest.raises(FileNotFoundError):
        shelf.array("words-900", np.int64)


def test_losses_summed_by_tasks_give_the_same_temperature(spark):
    """Against the rows' logits in one array, over several partitions, with many shards."""
    rng = np.random.default_rng(4)
    labels = ["x", "y"]
    texts = [("x" if i % 2 else "y", " ".join(rng.choice(["aa", "ab", "ba"] if i % 2 else ["cc", "ab", "dc"], 6))) for i in range(60)]
    weights, idf = rng.normal(size=(256, 2)) * 3, np.ones(256)
    kept = spark.createDataFrame(texts, "label string, text string").repartition(3)
    logits = []
    for _, text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        [found] = language_id.text_counts(data, np.array([0, len(data)]), 8)
        at, values = language_id.tf_idf(*found, idf)
        logits.append(values @ weights[at])
    expected = language_id.temperature(np.array(logits), np.array([labels.index(x) for x, _ in texts]))
    assert language_id.calibrated(kept, spark.sparkContext.broadcast((weights, idf)), labels) == pytest.approx(expected, rel=1e-9)
    assert language_id.calibrated(kept.limit(0), spark.sparkContext.broadcast((weights, idf)), labels) == 1.0


def test_language_id_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SHARD_ROWS", 5)
    rng = np.random.default_rng(2)
    data = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor"] if i % 2 else ["und", "nicht", "auch"], 8)), "la" if i % 2 else "de", "s", 0) for i in range(160)]
    got = collected(language_id.identified(frame(spark, data), F.crc32(F.col("doc_id").cast("string")) % 4 == 2))
    assert sum(r["lang_pred"] == ("la" if d % 2 else "de") for d, r in got.items()) > 150

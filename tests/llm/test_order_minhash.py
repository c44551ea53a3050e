import hashlib

from pyspark.sql import functions as F

from lakesync.llm import order_minhash
from hard_rows import hard, nothing  # noqa: F401


def test_neighbours_and_edited_texts(spark):
    docs = [(k * k * 7 - 50, "".join(f"w{(k * j) % 53} " for j in range(k % 9))) for k in range(400)]
    rows = {r["doc_id"]: r for r in order_minhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    ordered = sorted(docs)
    for (doc, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[doc]["n_chars"] == len(text)
    same = {}
    for doc, text in docs:
        assert same.setdefault(" ".join(text.split()), rows[doc]["fingerprint"]) == rows[doc]["fingerprint"]


def test_blocks_do_not_depend_on_ids(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 32)
    wide = [(k, f"wide {k} text") for k in range(300)] + [(1 << 60, "far away")]
    lost = [(None, f"no id {k}") for k in range(200)]
    equal = [(77, "the same row again")] * 150 + [(78, f"one id, text {k}") for k in range(90)]
    docs = wide + lost + equal
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    read = df.select("doc_id", F.col("text").alias("__text"), F.xxhash64("text").alias("__hash"))
    borders = order_minhash._borders(read.select("doc_id", "__hash"))
    assert len(borders) >= len(docs) / 32
    followed = order_minhash.with_next(read, read.select("doc_id", "__hash"), ["doc_id", "__hash", "__text"]).collect()
    key = lambda d, h: (d is not None, d or 0, h)
    ordered = sorted(key(r["doc_id"], r["__hash"]) for r in read.collect())
    assert sorted((key(r["doc_id"], r["__hash"]), key(r["next"]["doc_id"], r["next"]["__hash"])) for r in followed) == sorted(
        zip(ordered, ordered[1:] + ordered[:1]))


def plain_signature(spark, text):
    """Order MinHash with loops and dictionaries; only the hash function is Spark's."""
    def hashed(*values):
        return spark.range(1).select(F.xxhash64(*(F.lit(v) if isinstance(v, str) else F.lit(v).cast(t) for v, t in values))).first()[0]

    low, words = (1 << 30) - 1, [hashed((w, "string")) for w in text.split()]
    kmers = [hashed(*((h, "long") for h in words[i:i + 2])) & ~low for i in range(max(len(words) - 1, min(1, len(words))))]
    seen, parts = {}, {}
    for at, h in enumerate(kmers):
        n = seen[h] = seen.get(h, -1) + 1
        number = hashed(((h % (1 << 64)) >> 30, "long"), (n, "int")) & ~low
        parts.setdefault((number % (1 << 64)) >> 59, []).append((number, at, (number % (1 << 64)) >> 30))
    out = [None] * 32
    for part, found in parts.items():
        picked = sorted(sorted(found)[:2], key=lambda f: f[1])
        out[part] = hashed(*((f[2], "long") for f in picked)) & 0xFFFFFFFF
    return out


def test_signature_against_plain_loops(spark):
    texts = ["a b c a b c a b d", "one", "", "x y " * 3 + "z", " ".join(f"w{k % 5}" for k in range(12))]
    assert signatures(spark, texts) == [plain_signature(spark, t) for t in texts]


def signatures(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["s"] for r in order_minhash.add_signature(df, "t", "s").orderBy("i").collect()]


def alike(a, b):
    used = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in used) / len(used)


def test_order_matters_and_edits_show(spark):
    words = [f"v{k}" for k in range(600)]
    swapped = words[300:] + words[:300]
    few = [*words[:200], "x", *words[201:]]
    whole, moved, changed, other, twice = signatures(spark, [" ".join(x) for x in (words, swapped, few, [w + "q" for w in words], words + words)])
    assert alike(whole, changed) > 0.8 > alike(whole, moved) > alike(whole, other) == 0
    assert twice != whole  # repeated k-mers are numbered, so they count


def test_hard_rows(hard, nothing):
    rows = order_minhash.fingerprints(hard).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == hard.count() and by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0
    assert by[4]["fingerprint"] == "-" * 256 and by[4]["near_next"] == 1.0 and by[2]["near_next"] == 0.0
    assert order_minhash.fingerprints(nothing).count() == 0

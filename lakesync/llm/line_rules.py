"""Quality rules on lines that many documents of a host share.

Lines are normalised (lower case, without regard to white space, digit runs as 0) and hashed.  For every host the number
of distinct documents with a line is counted; a text that occurs many times counts once.  So do, all together, the texts of
a host that are made of shared lines (less than ``MIN_LEFT_PERCENT`` of their characters stand in lines of their own, which
fewer than ``MIN_DOCS`` documents have): near copies of each other are such texts, and they do not prove a line to be
boilerplate; they are left to the near-duplicate stage.  Lines in more than ``MAX_SHARE_PERCENT`` of a host's documents
counted like that, or in ``MAX_DOCS`` of them whatever the host's size, and in ``MIN_DOCS`` of them at least, are removed.
A document is rejected where the removal leaves too little of it (``is_depleted``) or a base rule fails.  Everything is a
DataFrame expression: windows are hashed and sorted inside the row, lines are grouped by hash with partial counts, and the
texts are not shuffled.

Defined results: a null text has no words and fails the base rule; a null host is a host of its own; repeated rows get the
same verdict; a very long text is read whole, like any other; there are no ties, since limits are compared and nothing is
ranked; an empty table gives an empty table; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import SPACES, free_names, materialise, split_words, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is removed where it is in more than this percentage of a host's distinct documents, or in so many of them ...
MAX_SHARE_PERCENT = 5
MAX_DOCS = 100
#: ... and in so many of them at least.  Lines of so many documents are shared lines.
MIN_DOCS = 10
#: A document is depleted with less than this percentage of its lines' characters left.
MIN_LEFT_PERCENT = 20


def normalised(text: Column) -> Column:
    """Lower case, digit runs as 0; lines of it are trimmed as well."""
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, base measures, ``doc`` (hash of the text) and ``lines`` (hash and length of each line).

    All of it is made inside the row, in one scan; the result is narrow and stands for the texts from then on.
    """
    text, words, windows, lines = F.col("__text"), F.col("__words"), F.col("__windows"), F.col("__lines")
    hashes = F.col("__hashes")
    at = lambda array, i: F.get(array, i.cast("int"))  # noqa: E731
    window_hash = lambda h, i: F.xxhash64(h, *(at(hashes, i + k) for k in range(1, WINDOW)))  # noqa: E731
    in_order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    again, starts = F.col("__again"), F.col("__starts")
    repeated = F.filter(again, lambda x, i: ((i > 0) & (x["h"] == at(again, i - 1)["h"])) | F.coalesce(x["h"] == at(again, i + 1)["h"], F.lit(False)))
    covered = F.transform(starts, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - at(starts, i - 1))))
    hashed_lines = F.transform(F.filter(F.split(normalised(text), "\n"), has_word),
                               lambda x: F.struct(line_hash(x).alias("line"), F.length(x).alias("chars")))
    return (
        docs.select("doc_id", "source", text_or_empty().alias("__text"))
        .withColumn("__words", split_words(text))
        .withColumn("__lines", F.filter(F.split(text, "\n"), has_word))
        .withColumn("__hashes", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("__windows", F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))), window_hash))
        .withColumn("__twice", F.size(F.array_distinct(windows)) < F.size(windows))
        .withColumn("__again", F.when(F.col("__twice"), in_order).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
        .withColumn("__starts", F.sort_array(F.transform(repeated, lambda x: x["at"])))
        .select(
            "doc_id", "source", F.xxhash64(text).alias("doc"), hashed_lines.alias("lines"), F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x).alias("n_repeat_words"),
        )
    )


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda total, x: total + x["chars"])


def _without(removed: str) -> Column:
    """The characters of the lines that are not in the array ``removed``, which may be null."""
    left = F.filter("lines", lambda x: ~F.array_contains(F.col(removed), x["line"]))
    return F.when(F.col(removed).isNull(), _chars(F.col("lines"))).otherwise(_chars(left))


def shared_lines(measured: DataFrame) -> DataFrame:
    """(host, doc, lines, made_of): the lines of each distinct document that MIN_DOCS documents of its host have, and whether
    it is made of such lines.  Documents without shared lines have no row."""
    lines = measured.select("host", "doc", F.explode("lines.line").alias("line")).distinct()
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs_in")).filter(F.col("docs_in") >= MIN_DOCS)
    sets = lines.join(counts.select("host", "line"), ["host", "line"]).groupBy("host", "doc").agg(F.collect_set("line").alias("shared"))
    made_of = _without("shared") * 100 < _chars(F.col("lines")) * MIN_LEFT_PERCENT
    return measured.join(sets, ["host", "doc"]).groupBy("host", "doc").agg(F.first("shared").alias("lines"), F.max(made_of).alias("made_of"))


def common_lines(measured: DataFrame) -> DataFrame:
    """(host, line, doc) of the lines above the limits, for each distinct document that has them."""
    shared = materialise(shared_lines(measured), "line-shared")
    # Documents made of shared lines count as one.
    made_of = F.sum(F.col("made_of").cast("long"))
    counted = F.count(F.lit(1)) - made_of + F.least(made_of, F.lit(1))
    spare = shared.filter("made_of").groupBy("host").agg((F.count(F.lit(1)) - 1).alias("spare"))
    hosts = measured.select("host", "doc").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    hosts = hosts.join(spare, "host", "left").select("host", (F.col("docs") - F.coalesce("spare", F.lit(0))).alias("docs_of"))
    lines = shared.select("host", "doc", "made_of", F.explode("lines").alias("line"))
    counts = lines.groupBy("host", "line").agg(counted.alias("docs_in")).filter(F.col("docs_in") >= MIN_DOCS)
    above = (F.col("docs_in") * 100 > F.col("docs_of") * MAX_SHARE_PERCENT) | (F.col("docs_in") >= MAX_DOCS)
    return lines.drop("made_of").join(counts.join(hosts, "host").filter(above).select("host", "line"), ["host", "line"])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, source, doc, the measures, base_failed, removed_lines (hashes), line_chars, chars_left and kept."""
    measured = materialise(measures(docs), "line-measures").withColumn("host", F.struct("source"))
    removed = common_lines(measured).groupBy("host", "doc").agg(F.sort_array(F.collect_set("line")).alias("removed_lines"))
    return (
        measured.join(removed, ["host", "doc"], "left")
        .withColumn("line_chars", _chars(F.col("lines")))
        .withColumn("chars_left", _without("removed_lines"))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
        .withColumn("is_depleted", F.col("chars_left") * 100 < F.col("line_chars") * MIN_LEFT_PERCENT)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("is_depleted"))
        .drop("host", "lines")
    )


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in ``removed``."""
    keep = lambda x: ~(has_word(x) & F.array_contains(removed, line_hash(normalised(x))))  # noqa: E731
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, without the removed lines, with the columns of ``docs`` (n_chars follows the text).

    The verdict depends on host and text only, so it joins on them; there is one row for each distinct text of a host.
    """
    host, doc, gone = free_names(docs, "__host", "__doc", "__removed")
    verdicts = judge(docs).filter("kept").groupBy(F.struct("source").alias(host), F.col("doc").alias(doc)).agg(
        F.first("removed_lines").alias(gone))
    keyed = docs.withColumn(host, F.struct("source")).withColumn(doc, F.xxhash64(text_or_empty()))
    joined, cut = keyed.join(verdicts, [host, doc]), F.size(gone) > 0
    changed = {"text": F.when(cut, without_lines(text_or_empty(), F.col(gone))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(changed["text"]).cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(changed).select(*docs.columns)


def op5_line_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_left", "kept")


SQL5 = r"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '[ 	

]+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	

]')) AS ls FROM d),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
    r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
    n AS (SELECT doc_id, source, t, trim(x, E' \t\n\x0b\f\r') AS line, length(x) AS chars
          FROM (SELECT doc_id, source, t, unnest(list_filter(string_split(regexp_replace(lower(t), '[0-9]+', '0', 'g'), chr(10)),
                                                             lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]'))) AS x FROM d)),
    s AS (SELECT source, line FROM n GROUP BY source, line HAVING count(DISTINCT t) >= 10),
    j AS (SELECT n.source, n.t, n.line, n.chars, s.line IS NOT NULL AS is_shared
          FROM (SELECT DISTINCT doc_id, source, t, line, sum(chars) OVER (PARTITION BY doc_id, line) AS chars FROM n) n
          LEFT JOIN s ON n.source IS NOT DISTINCT FROM s.source AND n.line = s.line),
    u AS (SELECT source, t, coalesce(sum(chars) FILTER (NOT is_shared), 0) * 100 < sum(chars) * 20 AS made_of FROM j GROUP BY source, t),
    f AS (SELECT j.source, line, count(DISTINCT j.t) FILTER (NOT made_of) + max(made_of::INT) AS docs_in
          FROM j JOIN u ON j.source IS NOT DISTINCT FROM u.source AND j.t = u.t WHERE is_shared GROUP BY j.source, line),
    h AS (SELECT d.source, count(DISTINCT d.t) FILTER (NOT coalesce(made_of, false)) + max(coalesce(made_of, false)::INT) AS docs_of
          FROM d LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.t = u.t GROUP BY d.source),
    m AS (SELECT f.source, line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
          WHERE docs_in >= 10 AND (docs_in * 100 > docs_of * 5 OR docs_in >= 100)),
    o AS (SELECT doc_id, sum(chars)::BIGINT AS lost FROM n JOIN m ON n.source IS NOT DISTINCT FROM m.source AND n.line = m.line GROUP BY doc_id),
    b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ 	

]', '', 'g'))::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
                 (coalesce(z.chars, 0) - coalesce(o.lost, 0))::BIGINT AS chars_left, coalesce(z.chars, 0) AS all_chars
          FROM w LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
                 LEFT JOIN (SELECT doc_id, sum(chars) AS chars FROM n GROUP BY doc_id) z USING (doc_id)),
    e AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
    SELECT * EXCLUDE (all_chars), NOT base_failed AND chars_left * 100 >= all_chars * 20 AS kept FROM e
"""

from collections import Counter

from lakesync.llm import line_rules
from hard_rows import hard, nothing  # noqa: F401


def test_hard_rows(hard, nothing):
    rows = {r["doc_id"]: r for r in line_rules.judge(hard).collect()}
    assert (rows[3]["n_words"], rows[3]["word_chars"], rows[3]["base_failed"], rows[3]["kept"]) == (0, 0, True, False)
    assert (rows[5]["n_words"], rows[5]["n_dup_lines"]) == (0, 0)
    assert (rows[7]["n_words"], rows[7]["n_dup_lines"], rows[7]["word_chars"]) == (9, 1, 5 + 4 + 2 + 1 + 5 + 14)
    assert rows[1]["kept"] and rows[1]["n_repeat_words"] == 0
    long = (hard.filter("doc_id = 6").first()["text"]).split()
    windows = Counter(tuple(long[i:i + 5]) for i in range(len(long) - 4))
    covered = {i + k for i in range(len(long) - 4) if windows[tuple(long[i:i + 5])] > 1 for k in range(5)}
    assert rows[6]["n_repeat_words"] == len(covered) and rows[6]["base_failed"]
    assert line_rules.judge(hard).count() == hard.count()
    assert line_rules.judge(nothing).count() == 0 and line_rules.kept_documents(nothing).count() == 0


def test_base_measures_by_hand(spark):
    text = "a b c d e x a b c d e y a b c d e\n\n$5 & #1\nsame line\n same line\nsame line"
    row = line_rules.judge(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (row["n_words"], row["n_repeat_words"], row["n_symbols"], row["n_dup_lines"]) == (26, 15, 3, 1)


def test_common_lines_go_and_depleted_documents_too(spark):
    body = lambda k: " ".join("abcdefghijkl"[j] * (k + 1) for j in range(12))
    own = [(k, f"subscribe NOW 2{k}\n" + body(k), "h") for k in range(30)]
    only = [(100, "Subscribe now 7", "h"), (101, "Subscribe now 8\nsubscribe now 9\n" + "subscribe now 1 " * 4, "h")]
    elsewhere = [(200, "subscribe now 3 and then ten more words that make it long enough", "other"), (201, "subscribe now 3\n" + "w " * 3, None)]
    docs = spark.createDataFrame(own + only + elsewhere, "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in line_rules.judge(docs).collect()}
    assert all(rows[k]["kept"] and len(rows[k]["removed_lines"]) == 1 for k in range(30))
    assert not rows[100]["kept"] and rows[200]["kept"] and rows[200]["removed_lines"] == []
    kept = {r["doc_id"]: r["text"] for r in line_rules.kept_documents(docs).collect()}
    assert set(kept) == {*range(30), 200}
    assert kept[3] == body(3)


def test_copies_count_once(spark):
    text = "one line of twelve words that is the same in every single copy\nand another"
    docs = spark.createDataFrame([(k, text, "h") for k in range(50)], "doc_id long, text string, source string")
    assert line_rules.kept_documents(docs).count() == 50


def pages(spark, rows):
    return spark.createDataFrame([(k, text, "h") for k, text in enumerate(rows)], "doc_id long, text string, source string")


def sentence(k, n=12):
    return " ".join("".join("abcdefghij"[int(d)] for d in str(1000 + 17 * k + j)) for j in range(n))


def test_near_copies_count_once(spark):
    lines = [sentence(1000 + j) for j in range(8)]
    copies = ["\n".join([*lines[:j % 8], sentence(5000 + j), *lines[j % 8 + 1:]]) for j in range(20)]
    others = [f"{sentence(9000 + k)}\n{sentence(20000 + k)}" for k in range(130)]
    kept = {r["doc_id"]: r["text"] for r in line_rules.kept_documents(pages(spark, copies + others)).collect()}
    assert kept == dict(enumerate(copies + others))


def test_lines_beyond_the_absolute_limit_go(spark):
    own = [sentence(100 * k) for k in range(4000)]
    above, below = "all rights of this page are reserved", "read more about it"
    rows = [text + ("\n" + above if k < 100 else "\n" + below if k < 199 else "") for k, text in enumerate(own)]
    kept = {r["doc_id"]: r["text"] for r in line_rules.kept_documents(pages(spark, rows)).collect()}
    assert [kept[k] for k in range(4000)] == own[:100] + rows[100:]


def test_extra_columns_stay(hard):
    kept = line_rules.kept_documents(hard)
    assert kept.columns == hard.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {1, 2, None}

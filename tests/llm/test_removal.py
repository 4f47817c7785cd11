"""Removals keep every row that the decision keeps, whatever its id."""

from faultline.llm import decontaminate, exact_dedup, ngram_jaccard

SCHEMA = "doc_id bigint, text string"
LONG = " ".join(f"w{i}" for i in range(60))


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_copies_go_by_row(spark):
    rows = [(1, "same"), (None, "Same"), (None, "alone"), (None, None), (2, "twice"), (2, "Twice"), (2, "other"), (3, "other"), (4, ""), (5, "own"), (5, "Same"), (6, "twice")]
    kept = left(exact_dedup.drop_exact_copies(spark.createDataFrame(rows, SCHEMA)))
    assert kept == sorted([(None, "alone"), (3, "other"), (4, ""), (5, "own"), (5, "Same"), (6, "twice")], key=str)


def test_contaminated_rows_go_by_row(spark):
    items = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    rows = [(None, LONG), (None, "clean words"), (None, None), (7, "x " + LONG), (7, "kept as it is"), (8, "clean")]
    kept = left(decontaminate.drop_contaminated(spark.createDataFrame(rows, SCHEMA), items))
    assert kept == sorted([(None, "clean words"), (None, None), (7, "kept as it is"), (8, "clean")], key=str)


def test_near_copies_go_by_row(spark):
    rows = [(1, LONG), (2, LONG + " end"), (2, "a text of its own without any likeness"), (None, LONG + " fin"), (None, "alone")]
    kept = left(ngram_jaccard.drop_near_copies(spark.createDataFrame(rows, SCHEMA)))
    assert kept == sorted([(1, LONG), (2, "a text of its own without any likeness"), (None, "alone")], key=str)


def test_one_of_repeated_rows_and_of_rows_without_ids_stays(spark):
    rows = [(1, "same text"), (1, "same text"), (1, "Same text"), (None, "no id"), (None, "no id"), (None, "No ID"), (3, ""), (3, None), (3, "")]
    kept = left(exact_dedup.drop_exact_copies(spark.createDataFrame(rows, SCHEMA)))
    assert [(i, (t or "").lower()) for i, t in kept] == [(1, "same text"), (3, ""), (None, "no id")]
    rows = [(1, LONG), (1, LONG), (1, LONG + " x"), (2, LONG), (None, "y " + LONG), (None, "five words of no copy"), (None, "five words of no copy"), (4, " ")]
    assert len(left(ngram_jaccard.drop_near_copies(spark.createDataFrame(rows, SCHEMA)))) == 3
    assert left(ngram_jaccard.drop_near_copies(spark.createDataFrame(rows[4:7], SCHEMA)))[0][0] is None


def test_columns_of_any_name_come_back(spark):
    names = ["_row", "_maybe", "_bucket", "_bits", "_byte", "_place", "_gone", "doc", "key", "maybe", "gone", "listed", "copies", "component", "a.b", "_text", "_key", "_id"]
    schema = ", ".join(f"`{n}` string" for n in names)
    values = [f"v{i}" for i in range(len(names))]
    rows = [(1, LONG, *values), (2, LONG, *values), (3, "clean words of its own", *values), (None, None, *values)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {schema}")
    items = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    for out, ids in ((exact_dedup.drop_exact_copies(docs), [2, 3, None]), (ngram_jaccard.drop_near_copies(docs), [1, 3, None]), (decontaminate.drop_contaminated(docs, items), [3, None])):
        assert out.columns == docs.columns
        got = sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is None, r[0]))
        assert [r[0] for r in got] == ids and all(list(r[2:]) == values for r in got)

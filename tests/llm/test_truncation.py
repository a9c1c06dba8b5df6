import random

from pyspark.sql import functions as F

from pagewright.llm import truncation as U


def brute(values):
    distinct = {v for v in values if v is not None}
    return {v for v in distinct if any(w != v and w.startswith(v) for w in distinct)}


def test_prefix_join(spark):
    rng = random.Random(1)
    values = ["".join(rng.choices("abé中", k=rng.randint(0, 7))) for _ in range(600)] + [None, "", "x" * 50_000, "x" * 49_000]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    got = [r.v for r in U.strict_prefixes(df, "v").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(values)
    assert U.strict_prefixes(df.limit(0), "v").count() == 0


def sentence(rng):
    who, what, how = rng.choice(["The scanner", "The loader", "Any relation"]), rng.choice(["reads", "keeps", "orders"]), rng.choice(["every damaged page in the second pass", "one report after another", "the total (see section 4.2)"])
    return f"{who} {what} {how}."


def log(rng):
    return f"2031-02-0{rng.randint(1, 9)}T0{rng.randint(1, 9)}:11:22Z level=info rel={rng.choice(['meter', 'depot'])} rows={rng.randint(1, 999)} msg=\"page kept\" elapsed={rng.randint(1, 999)} ms"


def sql(rng):
    return f"INSERT INTO depot VALUES ({rng.randint(1, 99)}, 'late', {rng.randint(1, 9)});"


def texts(seed, n=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = i % 3
        make, sep = ((sentence, " "), (log, "\n"), (sql, "\n"))[kind]
        text = sep.join(make(rng) for _ in range(rng.randint(2, 6)))
        whole, cut = text, False
        if rng.random() < 0.25:
            last = text.rsplit(sep, 1)[-1] if kind else text.split(". ")[-1]
            keep = rng.randint(3, len(last) - 4)
            whole, cut = text[: len(text) - len(last) + keep] + rng.choice(["", "", "…", " [cut]", "\n", "\x00", "\n```", "..."]), True
        elif kind == 0:
            whole += rng.choice(["", "", " And so on...", "\n-- export desk", "\n* late pages: 12\n* stale rows: 7", " (end)", "  "])
        rows.append((i, whole, ("guide", "log", "dump")[kind], cut))
    return rows


def test_cut_texts(spark):
    rows = texts(1) + [(9001, None, "guide", False), (9002, "", "guide", False), (9003, " \n", "guide", False), (9004, "The scanner reads " * 4000, "guide", True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, cut boolean").withColumn("unit", F.lit(1)).withColumn("value", F.lit("clash")).withColumn("is_open", F.lit(0))
    found = U.cut_texts(df)
    got = {r.doc_id for r in found.collect()}
    truth = {r[0] for r in rows if r[3]}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.02 * len(truth)
    rates = {r.source: (r.n_texts, r.n_cut) for r in U.cut_rates(df, found).collect()}
    assert rates["log"][0] == 133 and sum(n for _, n in rates.values()) == len(got)


def test_a_longer_copy_is_told(spark):
    base = "The loader keeps one report after another. The scanner reads every damaged pa"
    rows = [(1, base), (1, base), (2, base + "ge in the second pass."), (3, "Since version 4."), (4, "Since version 4.11 the page is kept.")]
    got = {r.doc_id: r for r in U.cut_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {1, 3} and got[1].longer and got[3].unit_longer


def test_a_longer_copy_outweighs_an_ending_that_lines_have(spark):
    others = [(10 + i, f"Number {i} is here.\nAlpha beta gamma delta\nMore of text {i} follows.") for i in range(4)]
    rows = [*others, (1, "Alpha beta gamma delta"), (2, "Alpha beta gamma delta epsilon zeta."), (3, "Some whole heading"), (4, "Some whole heading\nand what stands below it."), (5, "Every page is kept."), (6, "Every page is kept. The last one too.")]
    rows += [(20 + i, f"Number {i} is there.\nSome whole heading\nMore of page {i} follows.") for i in range(4)]
    got = {r.doc_id: r.longer for r in U.cut_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: True}


def test_long_endings_and_notes(spark):
    name = "x" * 400
    rows = [(i, f"Row {i} is kept.\nsee part/{name}\nThe next page {i} is kept.") for i in range(4)] + [(9, f"All is kept.\nsee part/{name}"), (10, "The page is kept. (" + "a note that is long " * 9 + ")")]
    assert U.cut_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0


def test_empty(spark):
    assert U.cut_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0

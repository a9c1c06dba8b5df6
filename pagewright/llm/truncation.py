"""Texts that were cut off: prefix self-join of whole values and of last units, with what closes a unit learned from the corpus."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans.lineage import materialize
from pagewright.plans.skew import skew_join

#: What may stand after a cut: white space, controls, lost bytes, ellipses, closing marks, fences, tags, bracketed notes.
RESIDUE = re.compile(r"(?:[\s\x00-\x1f\x7f�…\"'`“”»)\]}>]|\.{3,}|</\w+>|\([^()\n]+\)|\[[^\[\]\n]+\])+$")
TERMINAL = ".?!。？！"
_STATEMENT = re.compile(r"\s*(?:INSERT|CREATE|ALTER|UPDATE|DELETE|SELECT|DROP|SET|COPY|BEGIN|COMMIT|GRANT|COMMENT|WITH|TRUNCATE|MERGE)\s")
_LOG = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|(?<=[。？！])")
#: Writing without spaces between words: ideographs, kana, Thai, Lao, Khmer, Burmese.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
#: A line feed within a value of the prefix join: as the highest character it sorts what begins a new line behind what goes on.
BREAK = "\U0010ffff"
#: Units and texts kept by a task before they are handed on, in characters.
KEPT = 20_000_000
_DIGITS = re.compile(r"\d+")
#: A way to end is known, or a last unit is a formula, from this number of texts on.
SUPPORT = 3


def units_of(text: str) -> list[str]:
    """Lines that are log lines or statements as they are, other lines split into sentences; digits masked."""
    out = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        parts = [line] if _LOG.match(line) or _STATEMENT.match(line) else _SENTENCE.split(line)
        out += [_DIGITS.sub("9", p.strip()) for p in parts if p.strip()]
    return out


def signature(unit: str) -> str:
    """How a unit ends: the mark it begins with and its last two words, or last eight characters where words aren't spaced."""
    unit = unit.strip()
    lead = "a" if unit[:1].isalpha() else unit[:1]
    words = unit.split()
    if words and not _UNSPACED.search(words[-1]):
        return lead + " ".join(words[-2:])
    return lead + unit[-8:]


def judge(text: str) -> tuple[str, str, str, bool]:
    """The text without what stands after a possible cut, its last unit, how that ends, whether it is open."""
    core = RESIDUE.sub("", text)
    units = units_of(core.rsplit("\n", 1)[-1]) if core else []
    if not units:
        return core, "", "", False
    unit = units[-1]
    if _STATEMENT.match(unit):
        is_open = not core.endswith(";")
    elif core[-1] in TERMINAL:
        is_open = unit.count("(") > unit.count(")")
    else:
        is_open = True
    return core, unit, signature(unit), is_open


def strict_prefixes(values: DataFrame, column: str, reduced: bool = False) -> DataFrame:
    """The distinct values that are a strict prefix of another one: column, next (the character behind it in the first of
    the longer ones, in the order of code points).

    The values are sorted over all partitions; everything that starts with a value follows it at once, so each is
    compared with its successor only. The last value of a partition is compared with the first of the next that has
    any. NULLs are left out; the empty text is a prefix of every other. `reduced`: no value comes more than a few times.
    """
    some = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    placed = (some if reduced else some.distinct()).repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id())

    def scan(batches):
        import pandas as pd

        before, part = None, None
        for batch in batches:
            rows = []
            for v, p in zip(batch["v"], batch["p"]):
                if before is None:
                    part = int(p)
                    rows.append(("first", part, v, None))
                elif v == before:
                    continue
                elif v.startswith(before):
                    rows.append(("hit", part, before, v[len(before)]))
                before = v
            if rows:
                yield pd.DataFrame(rows, columns=["what", "p", "v", "next"])
        if before is not None:
            yield pd.DataFrame([("last", part, before, None)], columns=["what", "p", "v", "next"])

    scanned = materialize(placed.mapInPandas(scan, "what string, p int, v string, next string"))
    ends = scanned.where("what <> 'hit'").groupBy("p").agg(F.max(F.when(F.col("what") == "first", F.col("v"))).alias("first"), F.max(F.when(F.col("what") == "last", F.col("v"))).alias("last"))
    ends = ends.withColumn("after", F.lead("first").over(Window.orderBy("p")))  # one row for each partition
    over = ends.where(F.col("after").startswith(F.col("last"))).select(F.col("last").alias("v"), F.expr("substring(after, length(last) + 1, 1)").alias("next"))
    return scanned.where("what = 'hit'").select("v", "next").unionByName(over).withColumnRenamed("v", column)


def _mark(core: str) -> bytes:
    return hashlib.md5(core.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _scan(documents: DataFrame, key: str, column: str) -> DataFrame:
    """One pass over the texts: rows `doc` (each text's end), `end` (ways in which lines end before others), `value` (for the
    prefix join: u and a unit, t and a whole text), the last two reduced within a task."""
    kind = documents.schema[key].dataType.simpleString()

    def look(batches):
        import collections

        import pandas as pd

        names = ["what", "key", "mark", "value", "sig", "is_open", "n"]
        ends: collections.Counter[str] = collections.Counter()
        values: set[str] = set()
        held = 0

        def flush():
            rows = [("end", None, None, None, s, None, n) for s, n in ends.items()] + [("value", None, None, v, None, None, None) for v in values]
            ends.clear()
            values.clear()
            return rows

        def frame(rows):
            out = pd.DataFrame(rows, columns=names)
            out["key"] = out["key"].astype("object")
            return out

        for batch in batches:
            rows = []
            for k, text in zip(batch["k_"], batch["t_"]):
                core, unit, sig, is_open = judge(text)
                whole = "t" + core.replace("\n", BREAK)
                rows.append(("doc", k, _mark(whole) if is_open else None, unit, sig, is_open, None))
                if not core:
                    continue
                lines = core.split("\n")[:-1]
                ends.update({signature(_DIGITS.sub("9", x.strip())) for x in lines if x.strip() and x.rstrip()[-1] not in TERMINAL})
                for v in (whole, *("u" + u for u in units_of(core))):
                    if v not in values:
                        values.add(v)
                        held += len(v)
                if held > KEPT:
                    rows += flush()
                    held = 0
            if rows:
                yield frame(rows)
        if rest := flush():
            yield frame(rest)

    asked = documents.where(F.length(F.trim(F.coalesce(column, F.lit("")))) > 0).select(F.col(key).alias("k_"), F.col(column).alias("t_"))
    return asked.mapInPandas(look, f"what string, key {kind}, mark binary, value string, sig string, is_open boolean, n bigint")


def cut_texts(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Texts that end before their last sentence, log line or statement does: key, unit (the last one, digits masked), longer
    (the whole value goes on elsewhere), unit_longer (the last unit goes on elsewhere).

    What may follow a cut is taken off first. A text is open if its last unit then lacks its terminal mark (a statement:
    its semicolon) or closes fewer brackets than it opens. An open text that is a strict prefix of another one, which goes
    on in the same line, is cut. Any other open text counts as cut unless its unit ends as lines do that stand before
    others in at least SUPPORT texts, or is a formula: it closes at least SUPPORT texts and, by the prefix join of units,
    goes on nowhere. A unit that ends in a number and a full stop but goes on elsewhere is cut too. A text that ends where
    a sentence does is whole, even if another one begins with it.
    NULL, empty and blank texts are never cut; repeated texts count each.
    """
    spark_rows = materialize(_scan(documents, key, column), ["what"])
    docs = spark_rows.where("what = 'doc'").select("key", "mark", F.col("value").alias("unit"), "sig", "is_open")
    known = spark_rows.where("what = 'end'").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT).select("sig", F.lit(True).alias("sig_known"))
    hits = materialize(strict_prefixes(spark_rows.where("what = 'value'"), "value", reduced=True))
    long_units = hits.where(F.col("value").startswith("u")).select(F.expr("substring(value, 2)").alias("unit"), F.lit(True).alias("unit_longer"))
    long_texts = hits.where(F.col("value").startswith("t") & (F.length("value") > 1)).select(F.unhex(F.md5("value")).alias("mark"), (F.col("next") != BREAK).alias("longer"))
    numbered = F.col("unit").rlike("9\\.$")
    some = docs.where(F.col("is_open") | numbered)
    some = skew_join(some, long_texts, ["mark"], "left").withColumn("longer", F.coalesce("longer", F.lit(False)))
    some = skew_join(some, known, ["sig"], "left")
    some = some.where(~F.col("is_open") | F.col("sig_known").isNull() | F.col("longer")).drop("sig", "sig_known")
    some = materialize(skew_join(some, long_units, ["unit"], "left"))
    formulas = some.where("is_open and unit_longer is null and not longer").groupBy("unit").agg(F.count_distinct("mark").alias("n")).where(F.col("n") >= SUPPORT).select("unit", F.lit(True).alias("formula"))
    some = skew_join(some, formulas, ["unit"], "left")
    some = some.where(F.col("longer") | (F.col("is_open") & F.col("formula").isNull()) | (~F.col("is_open") & F.col("unit_longer").isNotNull()))
    return some.select(F.col("key").alias(key), "unit", "longer", F.coalesce("unit_longer", F.lit(False)).alias("unit_longer"))


def cut_rates(documents: DataFrame, cut: DataFrame, key: str = "doc_id", by: str = "source") -> DataFrame:
    """How often each source cuts: by, n_texts (with any text), n_cut, share."""
    flagged = cut.select(key).distinct().withColumn("is_cut", F.lit(1))
    rows = documents.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).select(key, by).join(flagged, key, "left")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.coalesce("is_cut", F.lit(0))).alias("n_cut"))
    return counts.withColumn("share", F.col("n_cut") / F.col("n_texts"))

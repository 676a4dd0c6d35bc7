"""Benchmark decontamination by template windows, in DataFrame functions only.

Tokens are words, numbers and currency or degree signs.  Their templates put <NUM> for numbers, <UNIT> for units of
measure, <NAME> for words of a capital and small letters, and the lower-cased word otherwise, so a question asked again
with other values has the same template.  Every window of ``width`` template tokens of a benchmark item (the whole item,
if it is shorter) with at least ``least_literals`` words is a key.  So is its folded template, in which names are lower-cased
words as well, so copies in other letter case share it.  Document windows are not all hashed: each benchmark
window has an anchor, its longest word, and only windows of a document around an anchor word are formed and hash-joined.

Windows of one document and item at the same shift form a run.  It is cut into its maximal sub-runs with consistent slots:
each benchmark value always stands for one value of the document, while two of them may stand for the same.  A document
with such a sub-run, of one window at least, counts as contaminated by the item.

Everything that grows with the corpus stays in rows of one document; the benchmark's tables are broadcast while they have
at most ``sized()`` rows and shuffled beyond.

An item without a usable window matches by its whole lower-cased token sequence: all its windows of plain tokens must be met
at one shift.

Null and empty texts match nothing; very long texts are whole; repeated rows, and rows with equal doc_id, give one result row
per doc_id and item, with the longest sub-run of any of them; rows with equal item_id are one item, found by any of its texts; an
empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import sized, written

TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*|[%$€£°]"

#: Units of measure that are not also common words.  Fixed values.
UNITS = """mm cm km mg kg lb lbs oz ml cl mi mph kmh khz mhz ghz kb mb gb tb kwh hz °  % $ € £
 meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres millimeter millimeters
 gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes liter liters litre litres gallon gallons
 mile miles foot feet inch inches yard yards acre acres hectare hectares
 second seconds minute minutes hour hours day days week weeks month months year years
 dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules newton newtons""".split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def template(word: Column) -> Column:
    return F.when(word.rlike("^[0-9]"), "<NUM>").when(F.lower(word).isin(UNITS), "<UNIT>").when(word.rlike(r"^\p{Lu}\p{Ll}"), "<NAME>").otherwise(F.lower(word))


def _literal(t: Column) -> Column:
    return ~t.isin("<NUM>", "<UNIT>", "<NAME>")


def _folded(raw: str, t: str) -> Column:
    """The template without names: they are lower-cased words, whatever their case."""
    return F.zip_with(raw, t, lambda word, x: F.when(x == "<NAME>", F.lower(word)).otherwise(x))


def _plain(raw: str) -> Column:
    """The key of a window of tokens as they are but for letter case; no token is the first sign."""
    return F.concat(F.array(F.lit("=")), F.transform(raw, F.lower))


def benchmark_windows(benchmark: DataFrame, width: int, least_literals: int) -> DataFrame:
    """(item_id, at, key, raw, anchor, off, w, plain, needed): the windows of each item; written."""
    items = benchmark.select("item_id", tokens(F.col("text").cast("string")).alias("raw")).filter(F.size("raw") > 0)
    items = items.withColumn("t", F.transform("raw", template)).withColumn("w", F.least(F.lit(width), F.size("raw")))
    enough = lambda t: F.size(F.filter(t, _literal)) >= least_literals
    starts = F.sequence(F.lit(0), F.size("raw") - F.col("w"))
    items = items.withColumn("f", _folded("raw", "t"))  # names are words of it, so enough in t is enough in f
    items = items.withColumn("plain", ~F.exists(starts, lambda at: enough(F.slice("f", at + 1, F.col("w")))))
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("w")).alias(c)
    windows = items.withColumn("needed", F.when(F.col("plain"), F.size(starts)).otherwise(1)).withColumn("at", F.explode(starts))
    windows = windows.select("item_id", "at", "w", "plain", "needed", cut("raw"), cut("t"), cut("f")).filter(F.col("plain") | enough("f"))
    windows = windows.withColumn("keys", F.when(F.col("plain"), F.array(_plain("raw"))).when(enough("t"), F.array_distinct(F.array("t", "f"))).otherwise(F.array("f")))
    windows = windows.withColumn("t", F.when(F.col("plain"), F.transform("raw", F.lower)).otherwise(F.col("keys")[0]))
    best = F.array_max(F.transform("t", lambda x, i: F.struct(F.when(_literal(x), F.length(x)).otherwise(0).alias("n"), (-i).alias("i"))))
    windows = windows.withColumn("off", -best["i"]).withColumn("anchor", F.element_at("t", F.col("off") + 1))
    windows = windows.withColumn("key", F.explode("keys"))
    return written(windows.select("item_id", "at", F.array_join("key", " ").alias("key"), "raw", "anchor", "off", "w", "plain", "needed"), "decontaminate-windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, least_literals: int = 4, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_windows, n_tokens (the longest sub-run), exact (some sub-run has the item's own values)."""
    keys = benchmark_windows(benchmark, width, least_literals)
    anchors = written(keys.groupBy("anchor").agg(F.collect_set(F.struct("off", "w", "plain")).alias("offs")), "decontaminate-anchors")
    # outer, so that no filter on the tokens' number makes them twice; null words meet no anchor
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), tokens(F.col("text").cast("string")).alias("words"))
    words = words.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("pos", "word"))
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    around = lambda df: df.withColumn("first", first).withColumn("around", F.slice("words", F.col("first") + 1, F.lit(2 * width - 1))).withColumn("n", F.size("words")).drop("words")
    meets = F.lower("word") == F.col("anchor")
    # beside few anchors a word's row may carry its document's words until it has met one; where rows are shuffled, only those around it
    near = around(words.join(F.broadcast(anchors), meets)) if anchors.count() <= broadcast_rows else around(words).join(anchors, meets)
    formed = near.withColumn("o", F.explode("offs")).withColumn("start", F.col("pos") - F.col("o.off")).filter((F.col("start") >= 0) & (F.col("start") + F.col("o.w") <= F.col("n")))
    formed = formed.select("doc_id", "text_hash", "start", F.slice("around", F.col("start") - F.col("first") + 1, F.col("o.w")).alias("own"), "o.plain")
    formed = formed.withColumn("t", F.transform("own", template))
    both = F.when(F.col("plain"), F.array(_plain("own"))).when(F.array_contains("t", "<NAME>"), F.array(F.col("t"), _folded("own", "t"))).otherwise(F.array("t"))
    formed = formed.select("doc_id", "text_hash", "start", "own", F.explode(both).alias("key")).withColumn("key", F.array_join("key", " "))
    met = formed.join(sized(keys.drop("plain")), "key")
    value = F.filter(F.transform(F.arrays_zip("raw", "own"), lambda x, i: F.struct((F.col("at") + i).alias("p"), template(x["raw"]).alias("kind"), F.lower(x["raw"]).alias("theirs"), F.lower(x["own"]).alias("own"))), lambda x: ~_literal(x["kind"]))
    runs = met.groupBy("doc_id", "text_hash", "item_id", (F.col("start") - F.col("at")).alias("shift")).agg(F.sort_array(F.collect_set("at")).alias("ats"), F.max("w").alias("w"), F.max("needed").alias("needed"), F.array_distinct(F.flatten(F.collect_set(value))).alias("slots"))
    return consistent(runs.filter(F.size("ats") >= F.col("needed"))).groupBy("doc_id", "item_id").agg(F.max("n").alias("n_windows"), F.max(F.col("last") + F.col("w") - F.col("first")).alias("n_tokens"), F.max("exact").alias("exact"))


def consistent(runs: DataFrame) -> DataFrame:
    """(doc_id, item_id, w, first, last, n, exact) of the maximal sub-runs in which a benchmark value has one value of the document."""
    distinct = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(*[x[k] for k in names]))))
    # a slot's latest earlier one with the same benchmark value and another value here: no sub-run covers both
    clash = F.transform("slots", lambda x: F.struct(x["p"].alias("p"), F.array_max(F.transform(F.filter("slots", lambda y: (y["p"] < x["p"]) & (y["kind"] == x["kind"]) & (y["theirs"] == x["theirs"]) & (y["own"] != x["own"])), lambda y: y["p"])).alias("q")))
    runs = runs.withColumn("clashes", F.when(distinct("kind", "theirs") == distinct("kind", "theirs", "own"), F.lit(None)).otherwise(F.filter(clash, lambda x: x["q"].isNotNull())))
    behind = lambda a: F.coalesce(F.array_max(F.transform(F.filter("clashes", lambda x: x["p"] < a + F.col("w")), lambda x: x["q"])), F.lit(-1))
    ends = runs.withColumn("ends", F.when(F.col("clashes").isNotNull(), F.transform("ats", lambda a: F.struct(a.alias("last"), behind(a).alias("q")))))
    within = F.transform("ends", lambda e: F.struct(e["last"].alias("last"), F.filter("ats", lambda a: (a > e["q"]) & (a <= e["last"])).alias("of")))
    subs = ends.withColumn("subs", F.transform(within, lambda e: F.struct(F.array_min(e["of"]).alias("first"), e["last"].alias("last"), F.size(e["of"]).alias("n"))))
    longer = lambda i: F.get("subs", i + 1)["first"]
    maximal = F.filter("subs", lambda x, i: x["first"].isNotNull() & ~x["first"].eqNullSafe(longer(i)))
    whole = F.array(F.struct(F.array_min("ats").alias("first"), F.array_max("ats").alias("last"), F.size("ats").alias("n")))
    found = subs.withColumn("sub", F.explode(F.when(F.col("clashes").isNull(), whole).otherwise(maximal)))
    own = F.forall("slots", lambda x: (x["p"] < F.col("sub.first")) | (x["p"] >= F.col("sub.last") + F.col("w")) | (x["theirs"] == x["own"]))
    return found.select("doc_id", "item_id", "w", "sub.*", own.alias("exact"))

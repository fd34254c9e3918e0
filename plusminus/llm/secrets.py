"""Secret scans (6): base patterns and a randomness test battery, in DataFrame functions alone.

Places of matches: the text split by a pattern gives what stands between the matches, and extracting all gives the
matches; running sums of their lengths are the starts in code points.

Texts are read once for the spans of the base patterns and the runs; only these, with the row's number, are kept for what
follows. masked() reads them once more to replace spans.

The battery looks at every run of 20 or more characters of an encoding's alphabet that holds no base match; runs of
standard base64 with a slash are tested beside the runs between slashes, and what is found of both is joined. The
narrowest alphabet that holds the run is inferred as its encoding. Three tests:
- chi-squared uniformity: Pearson's statistic of the symbol counts against an even use of the alphabet. Under the
  null hypothesis "the run is written text", with the collision rate of its encoding's written text, the statistic is
  close to a shifted normal variable; its lower tail is the p-value of the run being as even as it is.
- runs: the number of runs above and below the alphabet's middle; it may not differ from what chance gives.
- serial correlation of neighbouring symbols; it may not differ from zero.
The last two are gates (two-sided, |z| <= GATE_Z); the p-values of the runs that pass go through the step-up rule of
Benjamini and Hochberg at rate FDR in each class of lengths of its own, over the whole table: longer runs have more
power, and short ones, of which there are many, don't set the threshold of long ones. p-values are rounded up to a
grid of GRID steps a decade, so the rule needs one small row for each class and step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plusminus.llm.common import columns_of, fresh, saved, table, text_of
from plusminus.llm.lookup import numbered

KINDS = ("assign", "access", "hex")
#: The base patterns (fixed values); assign's second group needs LEAST["assign"] characters, the others the whole match.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
#: Runs of 20 and 24 characters at least: a run of these classes is matched whole, so the length can stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST_VALUE = 6
CANDIDATE = r"[A-Za-z0-9+_=-]{20,}"
#: Standard base64 has a slash, as paths have: a run with one is tested whole, and its parts between slashes too.
SLASHED = r"[A-Za-z0-9+/]{20,}={0,2}"
#: What a text with a run of either class has, and one with any span.
EITHER = r"[A-Za-z0-9+/_=-]{20,}"
ANY = f"{EITHER}|{ASSIGN}"
#: Inferred encodings, narrowest first: name, pattern, alphabet in order, collision rate of written text in it.
ENCODINGS = (
    ("decimal", r"[0-9]+", "0123456789", 0.20),
    ("hex", r"[0-9a-f]+|[0-9A-F]+", "0123456789abcdef", 0.14),
    ("base32", r"[A-Z2-7]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    ("lower", r"[a-z]+", "abcdefghijklmnopqrstuvwxyz", 0.066),
    ("alnum36", r"[a-z0-9]+", "0123456789abcdefghijklmnopqrstuvwxyz", 0.062),
    ("base62", r"[A-Za-z0-9]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.060),
    ("standard", r"[A-Za-z0-9+/]+=*", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.058),
    ("base64", r"[A-Za-z0-9+_=-]+", "+-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", 0.058),
)
GATE_Z, FDR, GRID = 2.58, 0.01, 50
#: Lengths from which a class begins.
CLASSES = (20, 24, 32, 48, 64, 128, 256)
#: Matches whose places are summed up at once.
BLOCK = 256
SPANS = "array<struct<start:long,end:long,kind:string,body:string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """An array of (start, end, kind, body): non-overlapping matches from the left, in code points; body is the match."""
    return _located(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), kind)


def _once(value: Column, use) -> Column:
    """use(value), with value computed once, however often it is used in functions of elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _located(between: Column, found: Column, kind: str) -> Column:
    """found with their places, by running sums of lengths: in blocks, so that many matches cost little more each than few."""
    size = lambda p: F.char_length(p["gap"]).cast("long") + F.char_length(p["body"]).cast("long")

    def block_step(state: Column, block: Column) -> Column:
        after = state["at"] + F.aggregate(block, F.lit(0).cast("long"), lambda total, p: total + size(p))
        one = F.struct(state["at"].alias("at"), block.alias("pairs"))
        return F.struct(after.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.char_length(pair["gap"]).cast("long")
        end = begin + F.char_length(pair["body"]).cast("long")
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["body"].alias("body"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def places(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda i: F.slice(pairs, i * BLOCK + 1, BLOCK))
        placed = F.array().cast("array<struct<at:long,pairs:array<struct<gap:string,body:string>>>>")
        begun = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), placed.alias("out")), block_step, lambda s: s["out"])
        out = F.transform(begun, lambda b: F.aggregate(b["pairs"], F.struct(b["at"].alias("at"), F.array().cast(SPANS).alias("out")), step, lambda s: s["out"]))
        return F.filter(F.flatten(out), lambda m: m["body"].isNotNull())  # what stands after the last match has none

    return _once(F.zip_with(between, found, lambda gap, body: F.struct(gap.alias("gap"), body.alias("body"))), places)


def base_spans(text: Column) -> Column:
    """The base matches that hold, by start and then by kind as listed; each has start, end, kind and body."""
    whole = matches(text, ASSIGN + VALUE, "assign")
    value = lambda m: F.char_length(F.regexp_replace(m["body"], "^" + ASSIGN, ""))
    return F.concat(F.filter(whole, lambda m: value(m) >= LEAST_VALUE), matches(text, ACCESS, "access"), matches(text, HEX, "hex"))


def _rank(kind: Column) -> Column:
    return F.when(kind == "assign", 0).when(kind == "access", 1).when(kind == "hex", 2).otherwise(3)


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by kind."""
    keyed = F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), _rank(m["kind"]).alias("rank"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a rational approximation (Abramowitz and Stegun 26.2.17), error below 1e-7 and relative in the tail."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(runs: DataFrame) -> DataFrame:
    """runs with column body, at least 20 characters: adds encoding, n, chi_z, runs_z, serial_z, p and length_class."""
    name, k, rate, alphabet = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for label, pattern, symbols, collisions in reversed(ENCODINGS):
        fits = F.col("body").rlike(f"^(?:{pattern})$")
        name, k = F.when(fits, label).otherwise(name), F.when(fits, len(symbols)).otherwise(k)
        rate, alphabet = F.when(fits, collisions).otherwise(rate), F.when(fits, symbols).otherwise(alphabet)
    runs = runs.select("*", name.alias("encoding"), k.alias("k"), rate.alias("rate"), alphabet.alias("alphabet"))
    # Padding is no symbol; an upper-case hex run is read in lower case.
    bare = F.regexp_replace("body", "=+$", "")
    runs = runs.withColumn("symbols", F.split(F.when(F.col("encoding") == "hex", F.lower(bare)).otherwise(bare), ""))
    runs = runs.withColumn("x", _once(F.col("alphabet"), lambda a: F.transform("symbols", lambda c: F.instr(a, c).cast("double"))))
    runs = runs.withColumn("n", F.size("x").cast("double")).filter("n >= 8")
    count = lambda c: F.size(F.filter("symbols", lambda s: s == c)).cast("double")
    squares = F.aggregate(F.array_distinct("symbols"), F.lit(0.0), lambda s, c: s + count(c) * count(c))
    n, k, mid = F.col("n"), F.col("k").cast("double"), (F.col("k").cast("double") + 1) / 2
    chi = squares * k / n - n
    far = n * (F.col("rate") * k - 1)  # how far written text moves the statistic
    chi_z = (chi - (k - 1) - far) / F.sqrt(2 * (k - 1) + 4 * far)
    turns = F.aggregate(F.sequence(F.lit(1), F.size("x") - 1), F.lit(1.0), lambda s, i: s + F.when((F.get("x", i) > mid) != (F.get("x", i - 1) > mid), 1.0).otherwise(0.0))
    above = F.size(F.filter("x", lambda v: v > mid)).cast("double")
    even = 2 * above * (n - above) / n
    spread = F.sqrt(F.greatest(even * (2 * above * (n - above) - n) / (n * (n - 1)), F.lit(1e-9)))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    mean = total / n
    power = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) / n - mean * mean
    # The sum of (x[i] - mean) * (x[i - 1] - mean), multiplied out: the mean in a function of elements is computed for each.
    products = F.aggregate(F.sequence(F.lit(1), F.size("x") - 1), F.lit(0.0), lambda s, i: s + F.get("x", i) * F.get("x", i - 1))
    lagged = products - mean * (2 * total - F.get("x", F.lit(0)) - F.element_at("x", -1)) + (n - 1) * mean * mean
    serial = F.when(power > 1e-9, lagged / (n * power)).otherwise(1.0)
    out = runs.select("*", chi_z.alias("chi_z"), ((turns - even - 1) / spread).alias("runs_z"), ((serial * F.sqrt(n)) + 1 / F.sqrt(n)).alias("serial_z"))
    length = F.lit(CLASSES[0])
    for low in CLASSES[1:]:
        length = F.when(n >= low, low).otherwise(length)
    return out.select("*", normal_cdf(F.col("chi_z")).alias("p"), length.alias("length_class")).drop("symbols", "x", "alphabet", "k", "rate")


def discoveries(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """The rows of tested that pass both gates and, in their class of lengths, the step-up rule."""
    step = F.floor(F.log10(F.greatest(F.col("p"), F.lit(1e-300))) * GRID).cast("int") + 1  # p <= 10 ** (step / GRID)
    passed = (F.abs("runs_z") <= GATE_Z) & (F.abs("serial_z") <= GATE_Z)
    tested = tested.withColumn("step", F.when(passed, step))
    # A row for each class and step: some thousands, whatever the input.
    each = tested.groupBy("length_class", "step").count()
    of_class = Window.partitionBy("length_class")
    ranked = each.withColumn("tests", F.sum("count").over(of_class)).withColumn("below", F.sum(F.when(F.col("step").isNotNull(), F.col("count"))).over(of_class.orderBy(F.col("step").asc_nulls_last())))
    held = ranked.filter(F.col("step").isNotNull() & (F.pow(F.lit(10.0), F.col("step") / GRID) * F.col("tests") <= F.col("below") * fdr))
    limit = held.groupBy("length_class").agg(F.max("step").alias("limit"))
    return tested.join(limit, "length_class").filter(F.col("step") <= F.col("limit"))


def _disjoint(spans: DataFrame) -> DataFrame:
    """(row, start, end): the spans of each row, those that overlap as one."""
    by_start = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("begins", F.when(F.col("start") < reached, 0).otherwise(1))
    return begins.withColumn("one", F.sum("begins").over(by_start)).groupBy("row", "one").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("one")


def spans_and_runs(rows: DataFrame) -> DataFrame:
    """rows with base, the base spans of text, and runs, what the battery tests: runs of an alphabet that meet no base span."""
    text = F.col("text")
    slashed = F.filter(matches(text, SLASHED, "random"), lambda m: F.contains(m["body"], F.lit("/")))
    runs = F.when(text.rlike(EITHER), F.concat(matches(text, CANDIDATE, "random"), slashed)).otherwise(F.array().cast(SPANS))
    rows = rows.withColumn("base", base_spans(text)).withColumn("runs", runs).drop("text")
    return rows.withColumn("runs", F.filter("runs", lambda r: ~F.exists(F.col("base"), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))


def random_spans(spans: DataFrame) -> DataFrame:
    """(row, start, end): the runs that the battery finds, those that overlap as one. spans: row and runs, read from files."""
    runs = spans.select("row", F.explode("runs").alias("m")).select("row", "m.start", "m.end", "m.body")
    # The rule needs all p-values twice; runs are few, and are tested once.
    tested = saved(battery(runs).select("row", "start", "end", "runs_z", "serial_z", "p", "length_class"), "tested")
    return _disjoint(discoveries(tested).select("row", "start", "end"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number), base and found: arrays of (start, end, kind, ...) of base and random spans."""
    rows = text_of(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    spans = saved(spans_and_runs(rows), "spans")
    found = random_spans(spans).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.lit("random").alias("kind")))).alias("found"))
    return spans.drop("runs").join(found, "row", "left").withColumn("found", F.coalesce("found", F.array()))


def masked(docs: DataFrame, mask: str) -> DataFrame:
    """docs with every found span of text replaced by mask, overlapping spans by one; all rows and columns stay, nulls too.

    Only rows that may have a span are joined. Repeated rows are masked alike; an empty table gives no rows.
    """
    row, hidden = fresh("row"), fresh("hidden")
    rows, text = numbered(docs, row), F.col("text")
    may = F.coalesce(text.rlike(ANY), F.lit(False))
    spans = saved(spans_and_runs(rows.filter(may).select(F.col(row).alias("row"), text.cast("string").alias("text"))), "spans")
    base = spans.select("row", F.explode("base").alias("m")).select("row", "m.start", "m.end")
    every = _disjoint(base.unionByName(random_spans(spans)))
    every = every.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(hidden))
    place = F.col(hidden)
    begin = lambda i: F.when(i > 0, F.get(place, i - 1)["end"]).otherwise(0).cast("int")
    between = F.transform(place, lambda s, i: F.substring(text, begin(i) + 1, s["start"].cast("int") - begin(i)))
    after = F.substring(text, F.element_at(place, -1)["end"].cast("int") + 1, F.lit((1 << 31) - 1))
    whole = F.array_join(F.concat(between, F.array(after)), mask)
    tested = rows.filter(may).join(saved(every, "hidden"), row, "left").withColumn("text", F.when(place.isNull(), text).otherwise(whole))
    return rows.filter(~may).select(*columns_of(docs)).unionByName(tested.select(*columns_of(docs)))


def find_secrets(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, the number of base matches of each kind, the digest of the base spans and all spans.

    A null text is empty: no spans, and the digest of the empty string. Matches of different kinds may overlap, and each
    is listed; a random span overlaps no base span. Repeated rows give the same spans, and count as often as they are
    there in the battery's rates. A null doc_id stays null. An empty table gives no rows.
    """
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    return scan(docs).select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.concat(F.transform("base", lambda m: m.dropFields("body")), "found")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))

r"""Secrets in texts: three patterns, and strings that a battery of tests takes for random.

Base spans are the matches of PATTERNS, leftmost and not overlapping within a kind, that reach the length of their kind (for
assignments the length of the value). A span is the whole match, in code points, end exclusive.

Random spans come from tokens of TOKEN. Its encoding is the smallest of ENCODINGS whose alphabet holds it and that
its classes of characters show: digits and letters, for alphabets of both cases those of either case. Words, numbers and paths of one class
show none and aren't tested. The symbols of a token are tested against the uniform distribution over the alphabet:
- chi-squared of the counts of symbols, by the cube root of Wilson and Hilferty (too uneven);
- runs above and below the middle of the alphabet, after Wald and Wolfowitz (too many, too few);
- serial correlation of neighbours' places in the alphabet (either way).
The three p-values make one by Sidak's rule, which is about uniform where the token is random and near zero where it isn't.

False discoveries, tokens that are taken for secrets but aren't random, are controlled by length, since short ordinary tokens are the
harder to tell: tokens of one encoding and one band of lengths (half powers of two above LEAST) share a threshold. Of the
tokens with p of at least t, random ones are a share 1 - t of all random ones, whose number is estimated by the
smallest of (tokens with p >= s, a standard deviation and one more) / (1 - s) for s up to one half. The threshold is the smallest of the STEPS
from 1 / STEPS on where the others among those kept are estimated at SHARE at most; without one, the band keeps none.
Counts by band are sums over all documents; there are at most len(ENCODINGS) * BANDS bands, so their thresholds are sent to all tasks.
A token that overlaps a base span isn't added.

Matches are cut out of the text with what lies between them (one scan), and places follow from lengths by a window over each
document's matches. Built-in expressions only; texts are neither shuffled nor written.

Defined results: null counts as empty; repeated rows each give a row; an empty table gives an empty result. A token
is tested whole, in blocks of BLOCK symbols where neighbours are needed. Only the two named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import settle

#: Kinds in the order in which they are listed: name, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RANDOM = "random"
LEAST = 20
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: A document without any of these has no match.
HINT = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{20}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, alphabet in order, and what a string of it shows, smallest first.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    ("hex_upper", _DIGITS + "ABCDEF", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    ("base32", _UPPER + "234567", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    ("base36", _DIGITS + _LOWER, "^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    ("base36_upper", _DIGITS + _UPPER, "^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    ("base62", _DIGITS + _UPPER + _LOWER, "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$"),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$"),
)
#: Bands of lengths; 2 ** 31 characters are in band 54.
BANDS = 56
BLOCK = 4096
STEPS = 20
SHARE = 0.1


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Of each match in order: kind, gap (characters since the one before), length, and token (null where it is dropped)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), counted.alias("counted"))
    found = F.filter(parts, lambda m: m["whole"].isNotNull())
    kept = lambda m: F.when(F.length(m["counted"]) >= least, m["whole"] if kind == len(PATTERNS) else F.lit(""))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("length"), kept(m).alias("token")))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number), doc_id and matches of all kinds, null where there are none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = [*PATTERNS, (RANDOM, TOKEN, 0, LEAST)]
    found = F.concat(*(_matches(text, k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(kinds)))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.when(text.rlike(HINT), found).alias("matches"))


def _placed(rows: DataFrame) -> DataFrame:
    """row, kind, start, end and token of each match that counts; of tokens those that overlap no base span."""
    each = rows.select("row", F.posexplode("matches").alias("place", "match")).select("row", "place", "match.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap").cast("long") + F.col("length")).over(before), F.lit(0)) + F.col("gap")
    placed = each.withColumn("start", start).select("row", "kind", "start", (F.col("start") + F.col("length")).alias("end"), "token").where("token IS NOT NULL")
    base = F.col("kind") < len(PATTERNS)
    reach = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start"))
    following = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc()))
    free = (F.coalesce(F.col("reach"), F.lit(0)) <= F.col("start")) & (F.col("following").isNull() | (F.col("following") >= F.col("end")))
    return placed.withColumns({"reach": reach, "following": following}).where(base | free).select("row", "kind", "start", "end", "token")


def _tail(z: Column) -> Column:
    """Probability of a normal deviate beyond |z|, both sides, to 1.5e-7 (Abramowitz and Stegun, 7.1.26)."""
    x = F.abs(z) / 2.0**0.5
    t = 1 / (1 + 0.3275911 * x)
    terms = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    return reduce(lambda acc, a: (acc + F.lit(a)) * t, reversed(terms), F.lit(0.0)) * F.exp(-x * x)


def _by_encoding(value) -> Column:
    """A value of each token's encoding."""
    return reduce(lambda c, e: c.when(F.col("encoding") == e[0], F.lit(value(e))), ENCODINGS, F.when(F.lit(False), F.lit(value(ENCODINGS[0]))))


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (with a column token) with encoding, n, p_chi, p_runs, p_serial and p; encoding and p are null where none is shown."""
    body = F.rtrim(F.col("token"), F.lit("="))
    shown = F.coalesce(*(F.when(body.rlike(shows), F.lit(name)) for name, _, shows in ENCODINGS))
    own = tokens.withColumns({"encoding": shown, "body": body})
    alphabet = _by_encoding(lambda e: e[1])
    halves = _by_encoding(lambda e: "l" * (len(e[1]) // 2) + "h" * (len(e[1]) - len(e[1]) // 2))
    own = own.withColumns({"n": F.length("body").cast("double"), "k": _by_encoding(lambda e: float(len(e[1]))), "alphabet": alphabet, "half": F.call_function("translate", body, alphabet, halves)})
    # how often each symbol occurs, and the places of all in the alphabet, block by block
    counts = F.transform(F.filter(F.split("alphabet", ""), lambda s: s != ""), lambda s: F.length("body") - F.length(F.replace(F.col("body"), s)))
    levels = F.transform(F.regexp_extract_all("body", F.lit(f".{{1,{BLOCK}}}"), F.lit(0)), lambda b: F.transform(F.filter(F.split(b, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.col("alphabet"), c).cast("double") - 1))
    own = own.withColumns({"counts": counts, "levels": levels})
    zero, plus = F.lit(0.0), lambda x, y: x + y
    neighbours = lambda v: F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda x, y: x * y), zero, plus)
    ends = lambda v: F.element_at(v, 1) + F.element_at(v, -1)
    own = own.withColumns({
        "squares": F.aggregate("counts", zero, lambda s, c: s + c.cast("double") * c),
        "total": F.aggregate(F.transform("counts", lambda c, i: c.cast("double") * i), zero, plus),
        "power": F.aggregate(F.transform("counts", lambda c, i: c.cast("double") * i * i), zero, plus),
        "products": F.aggregate(F.transform("levels", neighbours), zero, plus),
        "ends": F.aggregate(F.transform("levels", ends), zero, plus),
        "blocks": F.size("levels").cast("double"),
        "low": F.length(F.replace(F.col("half"), F.lit("h"))).cast("double"),
        "stretches": (F.regexp_count("half", F.lit("l+")) + F.regexp_count("half", F.lit("h+"))).cast("double"),
    })
    n, k = F.col("n"), F.col("k")
    df = k - 1
    chi = F.greatest(k / n * F.col("squares") - n, F.lit(0.0))
    cube = 2 / (9 * df)
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - cube)) / F.sqrt(cube)
    p_chi = F.when(z_chi > 0, _tail(z_chi) / 2).otherwise(1 - _tail(z_chi) / 2)
    twice = 2 * F.col("low") * (n - F.col("low"))
    spread = F.sqrt(twice * (twice - n) / (n * n * (n - 1)))
    p_runs = F.when(twice > n, _tail((F.col("stretches") - twice / n - 1) / spread)).otherwise(0.0)
    mean = F.col("total") / n
    # sum of (x - mean) * (y - mean) over neighbours: each symbol is in two pairs but for those at the ends of blocks
    joint = F.col("products") - mean * (2 * F.col("total") - F.col("ends")) + (n - F.col("blocks")) * mean * mean
    variation = F.col("power") - n * mean * mean
    p_serial = F.when(variation > 0, _tail((joint / variation + 1 / n) * F.sqrt(n))).otherwise(0.0)
    tested = own.withColumns({"p_chi": p_chi, "p_runs": p_runs, "p_serial": p_serial})
    p = 1 - F.pow(1 - F.least("p_chi", "p_runs", "p_serial"), F.lit(3.0))
    return tested.select(*tokens.columns, "encoding", n.cast("long").alias("n"), *(F.when(F.col("encoding").isNotNull(), c).alias(name) for name, c in (("p_chi", F.col("p_chi")), ("p_runs", F.col("p_runs")), ("p_serial", F.col("p_serial")), ("p", p))))


def band(n: Column) -> Column:
    return F.floor(2 * F.log2(F.greatest(n, F.lit(LEAST)) / F.lit(float(LEAST)))).cast("int")


def thresholds(tested: DataFrame, share: float = SHARE) -> DataFrame:
    """encoding, band and threshold (null: none is kept). tested: encoding, band, p; at most len(ENCODINGS) * BANDS rows come out."""
    above = [F.sum((F.col("p") >= k / STEPS).cast("long")).alias(f"a{k}") for k in range(STEPS)]
    grouped = tested.groupBy("encoding", "band").agg(*above)
    random = F.least(*((F.col(f"a{k}") + F.sqrt(F.col(f"a{k}")) + 1) / (1 - k / STEPS) for k in range(STEPS // 2 + 1)))
    fits = [F.when((F.col(f"a{k}") > 0) & (random * (1 - k / STEPS) >= (1 - share) * F.col(f"a{k}")), F.lit(k / STEPS)) for k in range(1, STEPS)]
    return grouped.select("encoding", "band", F.coalesce(*fits).alias("threshold"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per document: doc_id and spans, an array of start, kind (its place in the list, RANDOM last), end and p (null for base spans), in order."""
    rows = settle(_scanned(docs, id_col, text_col))
    placed = settle(_placed(rows))
    tested = battery(placed.where(F.col("kind") == len(PATTERNS))).where("encoding IS NOT NULL").withColumn("band", band(F.col("n")))
    tested = settle(tested.select("row", "kind", "start", "end", "encoding", "band", "p"))
    # a row for each encoding and band
    limits = F.broadcast(settle(thresholds(tested, share)))
    random = tested.join(limits, ["encoding", "band"]).where("p >= threshold").select("row", "kind", "start", "end", "p")
    base = placed.where(F.col("kind") < len(PATTERNS)).select("row", "kind", "start", "end", F.lit(None).cast("double").alias("p"))
    spans = base.unionByName(random).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "p"))).alias("spans"))
    found = rows.select("row", "doc_id").join(spans, "row", "left")
    return found.select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def listed(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans (kind:start:end, comma-joined)."""
    names = F.array(*(F.lit(name) for name, *_ in PATTERNS), F.lit(RANDOM))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(PATTERNS)), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))

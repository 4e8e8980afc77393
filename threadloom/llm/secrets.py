"""Secret scan: patterns, and a battery of randomness tests for tokens that no pattern names.

Everything is native SQL. Beyond the three base patterns every long token is a candidate. Its
encoding is inferred from its characters, and three tests ask whether it looks drawn at random from
that alphabet, whose characters stand in the order of their frequency in ordinary text: chi-squared
uniformity over eighths of the alphabet, runs above and below its middle, and lag-one serial
correlation. Their z-scores add up to one statistic, small for random tokens.

How small it gets by chance in ordinary text is measured on the corpus itself: all stretches of all
texts, written in the same alphabet and as long as the candidates, give the statistic's distribution,
and thus each candidate's p-value. Benjamini-Hochberg within each encoding and class of length holds
the rate of false discoveries. Both distributions meet as histograms of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, text_of
from .spans import apart, found, joined, let

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

#: A candidate: a long token that isn't a plain word.
TOKEN = r"(?:(?<![A-Za-z0-9+/_=-])|\G)(?![A-Z]?[a-z]++(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"

#: Letters by their frequency in ordinary text, and the alphabets in such an order.
_LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
#: Encodings in the order in which they are tried: their shape, and their alphabet after ``_folded``.
ENCODINGS = [
    ("dec", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$|^[0-9A-F]+$", "eadcbf0123456789"),
    ("base32", "^[A-Z2-7]+=*$", _LETTERS + "234567"),
    ("base36", "^[a-z0-9]+$|^[A-Z0-9]+$", _LETTERS + "0123456789"),
    ("base64", "", _LETTERS + _LETTERS.upper() + "0123456789+/"),
]
_GROUPS = "01234567"
#: First lengths of the classes.
CLASSES = [20, 24, 28, 32, 40, 48, 64, 96, 160]
#: So many characters outside an alphabet end a run of it in ordinary text.
GAP = 16
_BINS = 8  # of the statistic, for 1
_OPEN = "\x01"  # between runs


def encoding(token: Column) -> Column:
    """The number of the inferred encoding."""
    out = None
    for k, (_, shape, _) in enumerate(ENCODINGS[:-1]):
        out = F.when(token.rlike(shape), k) if out is None else out.when(token.rlike(shape), k)
    return out.otherwise(len(ENCODINGS) - 1)


def _groups(kind: int) -> list[int]:
    """The eighth in which each character of the alphabet lies."""
    k = len(ENCODINGS[kind][2])
    return [j * len(_GROUPS) // k for j in range(k)]


def _folded(token: Column, kind: int) -> Column:
    """The token with the characters of its alphabet only."""
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    return bare if kind == len(ENCODINGS) - 1 else F.lower(bare)


def _eighths(folded: Column, kind: int) -> Column:
    """Each character as the digit of its eighth."""
    return F.translate(folded, ENCODINGS[kind][2], "".join(_GROUPS[g] for g in _groups(kind)))


def _shares(kind: int) -> Column:
    places = _groups(kind)
    return F.array(*(F.lit(places.count(g) / len(places)) for g in range(len(_GROUPS))))


def _class(n: Column) -> Column:
    out = F.lit(0)
    for k, first in enumerate(CLASSES[1:], 1):
        out = F.when(n >= first, k).otherwise(out)
    return out


def battery(eighths: Column, shares: Column) -> Column:
    """struct(n, uniform, runs, serial, total): three z-scores, standard normal for random tokens, and the statistic."""

    def tests(x: Column) -> Column:
        n = x["n"].cast("double")
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        off = lambda c, e: (c - n * e) * (c - n * e) / (n * e)
        df = len(_GROUPS) - 1
        uniform = (add(F.zip_with(x["c"], x["e"], off)) - df) / (2 * df) ** 0.5
        sides = F.translate(x["d"], _GROUPS, "aaaabbbb")
        changes = F.length(F.regexp_replace(sides, r"(.)\1+", "$1")) - 1
        runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        mean = add(F.transform(x["c"], lambda c, g: c * g)) / n
        var = add(F.transform(x["c"], lambda c, g: c * (g - mean) * (g - mean)))
        both = add(F.zip_with(F.slice(x["v"], 1, x["n"] - 1), F.slice(x["v"], 2, x["n"] - 1), lambda a, b: (a - mean) * (b - mean)))
        serial = F.when(var > 0, (both / var + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        z = F.struct(x["n"].alias("n"), uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"))
        return let(z, lambda z: F.struct(z["n"], z["uniform"], z["runs"], z["serial"], (z["uniform"] - z["runs"] + F.greatest(z["serial"], F.lit(0.0))).alias("total")))

    count = lambda d, g: (F.length(d) - F.length(F.replace(d, F.lit(g), F.lit("")))).cast("double")
    inputs = lambda d: F.struct(
        d.alias("d"), F.length(d).alias("n"), shares.alias("e"), F.array(*(count(d, g) for g in _GROUPS)).alias("c"),
        F.transform(F.split(d, ""), lambda c: (F.ascii(c) - 48).cast("double")).alias("v"),
    )
    return let(let(eighths, inputs), tests)


def _of_token(token: Column) -> Column:
    """struct(kind, d, e) of a candidate: its encoding, the eighths of its characters and their shares of the alphabet."""

    def of(kind: Column) -> Column:
        pick = lambda columns: F.element_at(F.array(*columns), kind + 1)
        every = range(len(ENCODINGS))
        return F.struct(kind.alias("kind"), pick(_eighths(_folded(token, k), k) for k in every).alias("d"), pick(map(_shares, every)).alias("e"))

    return let(encoding(token), of)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base: (kind, start, end), candidates: (start, end, kind, test), kind being the encoding."""
    text = text_of(text_col)
    span = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    assign = F.filter(found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    parts = [F.transform(s, span(k)) for k, s in enumerate((assign, found(text, ACCESS), found(text, HEX)))]
    tested = lambda x: let(
        _of_token(x["m"]),
        lambda t: F.struct(x["start"].alias("start"), x["end"].alias("end"), t["kind"].alias("kind"), battery(t["d"], t["e"]).alias("test")),
    )
    return (
        docs.select(column(id_col).alias("doc_id"), F.concat(*parts).alias("base"), found(text, TOKEN, 1).alias("tokens"))
        .select("doc_id", "base", F.when(F.size("tokens") > 0, apart(F.col("tokens"), F.col("base"))).otherwise(F.col("tokens")).alias("tokens"))
        .select("doc_id", "base", F.transform("tokens", tested).alias("candidates"))
    )


def _bin(total: Column) -> Column:
    return F.greatest(F.least(F.floor(total * _BINS), F.lit(200 * _BINS)), F.lit(-20 * _BINS)).cast("int").alias("bin")


def totals(stretches: DataFrame, kind: int) -> DataFrame:
    """class, total: the ``battery``'s statistic of many stretches. stretches: class, d (eighths as digits).

    Twenty-one octal digits make a long, in which products of neighbours and changes of side are counted bits.
    """
    ones = F.lit(int("1" * 21, 8))
    plane = lambda x, k: F.shiftright(x, k).bitwiseAND(ones)
    packed = F.transform(F.sequence(F.lit(1), F.length("d"), F.lit(20)), lambda i: F.conv(F.substring(F.col("d"), i, F.lit(21)), 8, 10).cast("long"))

    def pairs(x: Column) -> Column:
        """The sum of neighbours' products, and from 10,000 on how many neighbours both lie above the middle; a long of 160 has 7791 at most."""
        out = F.lit(0).cast("long")
        for p in range(3):
            for q in range(3):
                out += F.bit_count(plane(x, p + 3).bitwiseAND(plane(x, q))) * ((1 << (p + q)) + (10000 if p == q == 2 else 0))
        return out

    rows = stretches.select(
        "class", F.length("d").alias("n"), (F.ascii("d") - 48).alias("first"), (F.ascii(F.right("d", F.lit(1))) - 48).alias("last"),
        *((F.length("d") - F.length(F.replace("d", F.lit(g), F.lit("")))).alias(f"c{g}") for g in _GROUPS),
        F.aggregate(packed, F.lit(0).cast("long"), lambda s, x: s + pairs(x)).alias("pairs"),
    )
    places, n = _groups(kind), F.col("n").cast("double")
    share = [places.count(k) / len(places) for k in range(len(_GROUPS))]
    c = [F.col(f"c{g}") for g in _GROUPS]
    added = lambda values: sum(values, F.lit(0.0))
    high = lambda x: (F.col(x) >= 4).cast("int")
    df = len(_GROUPS) - 1
    uniform = (added((x - n * e) * (x - n * e) / (n * e) for x, e in zip(c, share)) - df) / (2 * df) ** 0.5
    changes = 2 * (c[4] + c[5] + c[6] + c[7]) - high("first") - high("last") - 2 * F.floor(F.col("pairs") / 10000)
    rows = rows.select("*", uniform.alias("uniform"), ((changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("runs"), (added(x * k for k, x in enumerate(c)) / n).alias("mean"))
    mean = F.col("mean")
    rows = rows.withColumn("var", added(x * (k - mean) * (k - mean) for k, x in enumerate(c)))
    both = F.col("pairs") % 10000 - mean * (2 * n * mean - F.col("first") - F.col("last")) + (n - 1) * mean * mean
    serial = F.when(F.col("var") > 0, (both / F.col("var") + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    return rows.select("class", (F.col("uniform") - F.col("runs") + F.greatest(serial, F.lit(0.0))).alias("total"))


def ordinary(docs: DataFrame, text_col: str, wanted: list[tuple[int, int]]) -> DataFrame:
    """kind, class, bin, n: how the statistic falls in all stretches of all texts; of the encodings and classes ``wanted`` only.

    Long tokens are taken out. Characters of an encoding's alphabet with fewer than GAP others between neighbours make a run. For each
    class of length that is wanted a run is cut, from its start, into stretches as long as the class begins with; what
    is left at its end is no stretch.
    """
    bare = docs.select(F.regexp_replace(text_of(text_col), TOKEN, " ").alias("text"))
    out = None
    for kind in sorted({k for k, _ in wanted}):
        of = {x: _GROUPS[g] for x, g in zip(ENCODINGS[kind][2], _groups(kind))}  # character: the digit of its eighth
        of = {"-": of["+"], "_": of["/"]} | of if "+" in of else {x.upper(): g for x, g in of.items()} | of
        others = "[^" + "".join("\\" + x if x in "-+/" else x for x in sorted(of)) + "]"
        runs = F.regexp_replace(F.regexp_replace("text", f"{others}{{{GAP},}}+", _OPEN), f"{others[:-1]}{_OPEN}]+", "")
        runs = F.translate(runs, "".join(of), "".join(of.values()))
        cuts = (F.transform(F.regexp_extract_all("d", F.lit(f"[{_GROUPS}]{{{CLASSES[c]}}}"), F.lit(0)), _beside(c)) for k, c in sorted(wanted) if k == kind)
        stretches = bare.select(runs.alias("d")).select(F.explode(F.concat(*cuts)).alias("x")).select("x.class", "x.d")
        part = totals(stretches, kind).select(F.lit(kind).alias("kind"), "class", "total")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "class", _bin(F.col("total"))).agg(F.count(F.lit(1)).alias("n"))


def _beside(c: int):
    return lambda x: F.struct(F.lit(c).alias("class"), x.alias("d"))


def thresholds(scanned: DataFrame, docs: DataFrame, text_col: str, rate: float) -> dict[tuple[int, int], int]:
    """For each encoding and class of length the largest bin of the statistic that Benjamini-Hochberg accepts at this rate."""
    tests = scanned.select(F.explode("candidates").alias("x")).select(
        F.col("x.kind").alias("kind"), _class(F.col("x.test.n")).alias("class"), _bin(F.col("x.test.total"))
    )
    bins = lambda df: {(r.kind, r["class"], r.bin): r.n for r in df.collect()}  # noqa: E731  at most 1760 for each encoding and class
    asked = bins(tests.groupBy("kind", "class", "bin").agg(F.count(F.lit(1)).alias("n")))
    wanted = sorted({(k, c) for k, c, _ in asked})
    if not wanted:
        return {}
    chance = bins(ordinary(docs, text_col, wanted))
    out = {}
    for at in wanted:
        mine = sorted((b, n) for (*a, b), n in asked.items() if tuple(a) == at)
        null = [(b, n) for (*a, b), n in chance.items() if tuple(a) == at]
        total, every, seen = sum(n for _, n in mine), sum(n for _, n in null), 0
        for b, n in mine:
            seen += n
            if (1 + sum(m for c, m in null if c <= b)) / (1 + every) <= rate * seen / total:
                out[at] = b
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01, extreme: float = 3.3) -> DataFrame:
    """One row per input row: doc_id, base and spans, arrays of (kind, start, end) in the order of start, then kind.

    kind is a number, a place in KINDS. base holds what the three patterns find; spans also holds
    tokens accepted as random: a p-value within the false-discovery rate for their encoding and length, and
    no test beyond ``extreme``. Runs of decimal digits look alike in ordinary text, and so does anything in a
    corpus too small to tell chance from design: there no token is accepted. Tokens that overlap a base span
    aren't candidates. Places are code points, end exclusive. Null text counts as empty; rows that repeat an
    id are scanned each on its own. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    scanned = scratch.write(scan(docs, id_col, text_col), "scanned")
    limits = thresholds(scanned, docs, text_col, rate)
    key = lambda k, c: k * len(CLASSES) + c
    limit = F.array(*(F.lit(limits.get((k, c), -(1 << 30))) for k in range(len(ENCODINGS)) for c in range(len(CLASSES))))

    def random(x: Column) -> Column:
        test = x["test"]
        fits = _bin(test["total"]) <= F.element_at(limit, key(x["kind"], _class(test["n"])) + 1)
        return fits & (F.abs(test["uniform"]) <= extreme) & (F.abs(test["runs"]) <= extreme) & (F.abs(test["serial"]) <= extreme)

    accepted = F.filter("candidates", random)
    more = F.transform(accepted, lambda x: F.struct(F.lit(3).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    order = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda x: F.struct(x["start"], x["kind"], x["end"]))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    return scanned.select("doc_id", order(F.col("base")).alias("base"), order(F.concat("base", more)).alias("spans"))


def secret_digest(secrets: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return secrets.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
    )

"""Secrets in texts with DataFrame functions only: fixed patterns, and strings of high entropy."""

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed patterns of the contract: name, pattern, group that is measured, least length of it. Kinds sort in this order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short never holds a longer one, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Strings that may hide a secret: runs of the letters of base-64 and of paths, 20 at least, with padding.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Class, form of its runs, window, least bits a letter in some window; the first form that fits counts. A random window
#: of 20 base-64 letters has 4.0 bits on average, one of 24 hex letters 3.5. Runs without a digit are mostly words, which
#: stay under 4 bits, so their limit is stricter.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 24, 3.2), ("letters", r"^[A-Za-z/_=+-]+$", 24, 4.1), ("mixed", r"^.*$", 20, 3.7))
#: What looks like a secret and is none. Each match takes the windows that it touches out, not the run: examples and
#: sequences of the keyboard, ids of well-known form, eight equal letters, runs of digits and signs.
WORDS = ("example", "placeholder", "changeme", "xxxx", "0123456789", "abcdefgh")
ID = r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])"
REPEATED = r"(.)(?=\1{7})"
DIGITS = r"^[0-9/_=+-]+$"
#: Stands for a letter that the allow-list takes out; no run has it.
TAKEN = "~"


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, rank, end, kind, found>>, in code points.

    The pieces between the matches and the matches give the places. Matches whose group is shorter than `least` are
    dropped after they have taken their text.
    """
    rank = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}[kind]
    literal = F.lit(pattern)
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, literal, F.lit(0))
    measured = F.regexp_extract_all(text, literal, F.lit(group)) if group else whole
    moved = F.aggregate(
        F.arrays_zip(pieces.alias("gap"), whole.alias("found"), measured.alias("part")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,found:string,size:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0))).alias("at"),
            F.when(x["found"].isNull(), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + F.length(x["gap"]) + F.length(x["found"])).alias("end"),
                F.lit(kind).alias("kind"), x["found"].alias("found"), F.length(x["part"]).alias("size"),
            ))))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    kept = F.filter(moved, lambda m: m["size"] >= least) if least else moved
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,found:string,size:int>>")
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), kept).otherwise(none)


#: Counts of a window stand five bits each, twelve to a number; letters are numbered from "+" to "~".
FIRST, PACK, PACKS, BITS = ord("+"), 12, 7, 32
#: c * log2(c) in units of 2^-40, so that sums over a window are exact.
UNIT = 2.0**40
TERMS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(BITS)]


def top_entropy(word: Column, window: int) -> Column:
    """Largest Shannon entropy (bits a letter) of the windows of a string of candidate letters; of the whole if it is
    shorter. Windows that hold a taken letter do not count; 0 if none is left. `window` is 31 at most.

    One pass holds the counts of the window's letters and the sum of c * log2(c). A step adds one to the count of the
    letter that comes in, takes one from that of the letter that goes out, and changes the sum by their terms: its cost
    does not depend on the window, the alphabet or the length of the string.
    """
    n = F.least(F.length(word), F.lit(window))
    terms = F.array(*[F.lit(t) for t in TERMS])

    def place(letter):
        code = F.ascii(letter) - FIRST
        return F.struct(F.floor(code / PACK).cast("int").alias("at"), F.pow(F.lit(float(BITS)), code % PACK).cast("long").alias("one"))

    letters = F.transform(F.split(word, ""), place)
    none = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("one"))
    # The letter that goes out stands n places before the one that comes in.
    gone = F.slice(F.concat(F.array_repeat(none, n), letters), 1, F.size(letters))
    steps = F.transform(F.arrays_zip(letters.alias("new"), gone.alias("old")), lambda x, i: F.struct(x["new"].alias("new"), x["old"].alias("old"), (i + 1).alias("i")))
    taken = F.struct(F.lit((ord(TAKEN) - FIRST) // PACK).alias("at"), F.lit(BITS ** ((ord(TAKEN) - FIRST) % PACK)).cast("long").alias("one"))

    def count(counts, x):
        return (F.get(counts, x["at"]).bitwiseAND(x["one"] * (BITS - 1)) / x["one"]).cast("int")

    def term(c):
        return F.get(terms, c)

    def step(acc, x):
        same = x["old"] == x["new"]
        filling = x["old"]["at"] < 0
        out = F.when(filling | same, F.lit(0)).otherwise(count(acc["counts"], x["old"]))
        here = count(acc["counts"], x["new"])
        total = acc["total"] + F.when(same, F.lit(0)).otherwise(
            F.when(filling, F.lit(0)).otherwise(term(out - 1) - term(out)) + term(here + 1) - term(here)
        )
        counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, k: c + F.when(k == x["new"]["at"], x["new"]["one"]).otherwise(F.lit(0)) - F.when(k == x["old"]["at"], x["old"]["one"]).otherwise(F.lit(0))))
        last = F.when(x["new"] == taken, x["i"]).otherwise(acc["last"])
        least = F.when((x["i"] >= acc["n"]) & (x["i"] - last >= acc["n"]), F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"), last.alias("last"), acc["n"].alias("n"))

    most = F.lit(TERMS[-1]).cast("long")
    # n goes along, as the expression itself would be worked out for every letter.
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), PACKS).alias("counts"), F.lit(0).cast("long").alias("total"), most.alias("least"), F.lit(0).alias("last"), n.alias("n"))
    return F.aggregate(steps, start, step, lambda acc: F.when(acc["least"] == most, F.lit(0.0)).otherwise(F.log2(acc["n"]) - acc["least"] / (acc["n"] * UNIT)))


def without_allowed(word: Column) -> Column:
    """The string with every letter that an allow-list match covers taken out; its length stays."""
    for w in WORDS:
        word = F.regexp_replace(word, f"(?i){w}", TAKEN * len(w))
    word = F.regexp_replace(word, ID, TAKEN * 36)
    # Where eight equal letters begin; the rest of them are the next places of the same run.
    return F.regexp_replace(word, REPEATED, TAKEN)


def entropy_spans(text: Column) -> Column:
    """Candidate strings with a window that the allow-list leaves and whose entropy reaches the limit of the class."""
    def secret(word):
        reached, before = F.lit(False), ~word.rlike(DIGITS)
        for _, form, window, bits in CLASSES:
            reached = reached | (before & word.rlike(form) & (top_entropy(without_allowed(word), window) >= bits))
            before = before & ~word.rlike(form)
        return reached

    return F.filter(spans(text, CANDIDATE, "entropy"), lambda m: secret(m["found"]))


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of secrets: struct<start, rank, end, kind, found>, by start, then kind.

    Kinds: assign (a name such as password or token, a sign, a value of 12 or more), access (AKIA and 14 or more),
    hex (16 or more lower-case hex digits), entropy (other strings of high entropy in a window that no allow-list match
    touches). Places are code points, end exclusive. Null and empty texts have none; a run of any length costs time in
    proportion to it. Every row and column stays; no shuffle, no Python.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(spans(value, ASSIGN, "assign", 2, 12), spans(value, ACCESS, "access"), spans(value, HEX, "hex"))
    every = F.array_sort(F.concat(base, entropy_spans(value)))
    return docs.withColumn(out, F.transform(every, lambda m: m.dropFields("size")))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "secrets")

    def count(kind):
        return F.size(F.filter("secrets", lambda m: m["kind"] == kind)).cast("long")

    base = listed(F.filter("secrets", lambda m: m["kind"] != "entropy"))
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by the mark; overlapping spans are one. A null text stays null."""
    rows = scan(docs, text, "_secrets")
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    done = F.aggregate(
        "_secrets", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, m: F.when(m["end"] <= acc["at"], acc)
        .when(m["start"] < acc["at"], F.struct(acc["out"].alias("out"), m["end"].alias("at")))
        .otherwise(F.struct(F.concat(acc["out"], F.substr(value, acc["at"] + 1, m["start"] - acc["at"]), F.lit(mark)).alias("out"), m["end"].alias("at"))),
        lambda acc: F.concat(acc["out"], F.substr(value, acc["at"] + 1)),
    )
    return rows.withColumn(text, F.when(F.size("_secrets") > 0, done).otherwise(F.col(text))).drop("_secrets")

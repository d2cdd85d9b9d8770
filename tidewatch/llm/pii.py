"""Personal data: fixed forms, and identifiers found by the contexts that known ones stand in.

The fixed forms (email, ip, card, phone) give seeds. What is bootstrapped from them:

1. The context of each seed makes lexical patterns: the word before it, the word after it, and both. So does the
   context of every other word that looks like an identifier (an ``@`` or three digits) and is no seed.
2. Patterns and the values they extract form a graph. A pattern's score for a kind is the mean confidence, in
   that kind, of the different values it extracts; seeds have confidence one. A value's confidence is the
   noisy-or of the scores of its trusted patterns.
3. A pattern is trusted for a kind if its score reaches ``TRUST`` and it extracts at least ``SUPPORT`` different
   known values of it. Values whose confidence reaches ``TRUST`` become known, and count for patterns like seeds in
   the next round. This goes on until a round finds no value.
4. Known values are marked wherever they stand.

Values count once per pattern, so copies of a document don't make a pattern look well supported. All of it is
DataFrame expressions. Texts are read once; what goes on is one row per span.

Tables between the steps are written in as many files as the number of documents needs, however many partitions the
shuffles have: Hadoop's local file system starts a command for each file and folder it makes (chmod), and such a child
has its executor's whole memory until it is the command.

Java's regular expressions search from every position. The forms below start with a look at what stands before,
or after the last match (``\\G``), and take runs possessively; this finds the same matches in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a form to be searched at all.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_SPACE = r"\x20\x09-\x0D"
_IDENTIFIER = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"

TRUST = 0.8
SUPPORT = 5
#: Documents for each file of a table between the steps, and for each partition of the result.
FILE_ROWS = 16_000
_SPAN = "struct<start:int,end:int,value:string,left:string,right:string,ok:boolean>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if the weighted digits, every second one from the right doubled, sum to a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        digit = F.ascii(F.substring(digits, n - k, F.lit(1))) - 48
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(k % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(short(p)) <= 3) & (
            F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(x)
        return F.length(digits).between(13, 19) & F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, form: str, valid) -> Column:
    """All matches with their place in code points, the words around them, and whether they are valid.

    The pieces between matches give both: their lengths are the way from one match to the next, and their last
    and first words are what stands before and after. A word that touches the match counts as far as it goes.
    """
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    between = F.split(text, form, -1)
    word = lambda piece, at: F.lower(F.regexp_extract(piece, at, 1))
    empty = F.array().cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def add(so_far: Column, x: Column) -> Column:
        begin = so_far["at"] + F.length(x["before"])
        end = begin + F.length(x["value"])
        span = F.struct(
            begin.alias("start"), end.alias("end"), x["value"].alias("value"),
            word(x["before"], rf"([^{_SPACE}]{{1,40}})[{_SPACE}]*$").alias("left"),
            word(x["after"], rf"^[{_SPACE}]*([^{_SPACE}]{{1,40}})").alias("right"), valid(x["value"]).alias("ok"))
        return F.struct(end.alias("at"), F.concat(so_far["spans"], F.array(span)).cast(f"array<{_SPAN}>").alias("spans"))

    rows = F.arrays_zip(found.alias("value"), between.alias("before"),
                        F.slice(between, F.lit(2), F.size(found)).alias("after"))
    rows = F.slice(rows, F.lit(1), F.size(found))
    return F.when(F.size(found) > 0, F.aggregate(rows, start, add, lambda x: x["spans"])).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, one array of spans per kind, and ``others``: identifiers that no span touches."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       text.alias("text"))
    searched = {}
    for kind in KINDS:
        spans = _spans(F.col("text"), FORMS[kind], lambda x, kind=kind: _valid(kind, x))
        if _NEEDS[kind]:
            spans = F.when(F.contains("text", F.lit(_NEEDS[kind])), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))
        searched[kind] = F.filter(spans, lambda x: x["ok"])
    looks = lambda x: F.contains(x, F.lit("@")) | (F.length(_digits(x)) >= 3)
    found = rows.select("row", "doc_id", *[c.alias(k) for k, c in searched.items()],
                        _spans(F.col("text"), _IDENTIFIER, looks).alias("tokens"))
    own = F.concat(*[F.transform(k, lambda x: F.struct(x["start"], x["end"])) for k in KINDS])
    free = F.filter("tokens", lambda x: x["ok"] & ~F.exists(
        "own", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return found.withColumn("own", own).select("row", "doc_id", *KINDS, free.alias("others"))


def _contexts(x: Column) -> Column:
    """A span's patterns."""
    patterns = F.array(
        F.when(x["left"] != "", F.concat(F.lit("< "), x["left"])),
        F.when(x["right"] != "", F.concat(F.lit("> "), x["right"])),
        F.when((x["left"] != "") & (x["right"] != ""), F.concat(F.lit("<> "), x["left"], F.lit(" "), x["right"])))
    return F.array_compact(patterns)


def known_values(spans: DataFrame, files: int) -> DataFrame:
    """The values that contexts make known (value, kind, confidence), seeds left out; see the module's text.

    All tables are of different values and patterns, aggregated before they are joined. Known values only become
    more, so the rounds end; each writes its new ones out. Tables have at most so many ``files`` each.
    """
    written = lambda df: staged(df.coalesce(files))
    seeds = None
    for kind in KINDS:
        some = spans.select(F.lit(kind).alias("kind"), F.explode(kind).alias("x"))
        seeds = some if seeds is None else seeds.union(some)
    seeds = written(seeds.select("kind", F.col("x.value").alias("value"), F.explode(_contexts(F.col("x"))).alias("pattern")).distinct())
    others = spans.select(F.explode("others").alias("x"))
    others = others.select(F.col("x.value").alias("value"), F.explode(_contexts(F.col("x"))).alias("pattern"))
    edges = written(others.union(seeds.select("value", "pattern")).distinct())
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= SUPPORT))
    known = written(seeds.select("value", "kind", F.lit(1.0).alias("confidence"), F.lit(False).alias("found")).distinct())
    while True:
        mass = edges.join(known, "value").groupBy("pattern", "kind").agg(
            F.sum("confidence").alias("mass"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
        score = F.col("mass") / F.col("size")
        trusted = mass.join(sizes, "pattern").withColumn("score", score).where(F.col("score") >= TRUST)
        doubt = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("score"))))
        belief = edges.join(trusted.select("pattern", "kind", "score"), "pattern").groupBy("value", "kind").agg(
            (1 - F.exp(doubt)).alias("confidence"), F.lit(True).alias("found"))
        new = written(belief.where(F.col("confidence") >= TRUST).join(known.select("value", "kind"), ["value", "kind"], "left_anti"))
        if new.isEmpty():
            return known.where("found").drop("found")
        known = written(known.union(new))


def _numbered(kind: str, n: int) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(n).alias("k"), x["start"].alias("start"), x["end"].alias("end")))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans per kind, base_sha256, spans and n_added of every row of ``docs`` (doc_id, text).

    ``spans``: kind:start:end of all spans, by kind and start, comma-joined; places count code points, ends are
    exclusive. An added span has the kind in which its value is most certain. A null text is an
    empty one; null and repeated ids keep a row each; no rows give none. Other columns are not read.
    Rows are counted before, so ``docs`` that are costly to make should be written out.
    """
    files = max(1, -(-docs.count() // FILE_ROWS))
    spans = staged(base_spans(docs).repartition(files))
    values = known_values(spans, files)
    places = spans.select("row", F.explode("others").alias("x")).select("row", "x.start", "x.end", "x.value")
    best = places.join(values, "value").groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("x"))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("x.kind")).cast("int")
    added = best.groupBy("row").agg(F.collect_list(F.struct(number.alias("k"), "start", "end")).alias("added"))
    own = F.concat(*[_numbered(k, n) for n, k in enumerate(KINDS, 1)])
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda all_: F.array_join(F.transform(F.array_sort(all_), lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    more = F.coalesce("added", F.array().cast("array<struct<k:int,start:int,end:int>>"))
    found = spans.withColumn("own", own).join(added, "row", "left")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(F.col("own")), 256).alias("base_sha256"), text(F.concat("own", more)).alias("spans"),
        F.size(more).cast("long").alias("n_added")).coalesce(files)

r"""Secret scan with multipart credential linking, in DataFrame operations only.

Base spans stand on their own: `assign` (a keyword, a separator and a value of 8+ characters), `access` (AKIA...) and `hex`.
Weak candidates alone say little: `id` (a user or client name that is assigned, or an email address), `key` (an assigned value of 4 to 7
characters) and `endpoint` (a URL or an IPv4 address). They are linked by an interval join: parts of one text fall into bins of
SCOPE code points; each bin is reduced to the first start and the last end of every part, and each weak candidate is joined to
its own bin and the two beside it, so the join grows with the number of parts and never with their pairs. A candidate has a
partner if the gap between both spans is SCOPE at most. An identifier is reported beside a secret, a weak key beside an
identifier, an endpoint beside both. Identifiers: access, id; secrets: assign, hex, key.

Positions are code points, ends exclusive. Regular expressions give no positions in Spark, so each match is marked in the text
by control characters (which are first replaced in the text; no pattern contains them) and the lengths of the pieces add up.

Defined results: a null text counts as empty, with no span; null and repeated doc_ids are kept row by row; further columns are
left out (find) or kept (redact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.llm import common

#: Kinds in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
SCOPE = 240
#: Pieces of a text that are added up at a time, at least.
RUN = 64
#: Code points of the stretches into which a text is cut before spans are taken out of it.
STRETCH = 4096
#: Patterns with two groups: all that stands before the value, and the value.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA)([A-Z0-9]{12,})"
HEX = r"()([0-9a-f]{32,})"
ID = r"""((?:[uU][sS][eE][rR](?:[nN][aA][mM][eE]|_?[iI][dD])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY](?:_?[iI][dD])?)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=@-]{3,})"""
EMAIL = r"()((?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9.-]+)"
ENDPOINT = r"""()(https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.]))"""


def _let(value: F.Column, use) -> F.Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _found(text: F.Column, pattern: str) -> F.Column:
    """array<struct<start,end,value>> of the matches, value being the length of the second group.

    The pieces between marks are outside and inside of matches in turn. They are split once and added up in runs whose length
    is the root of their number (RUN at least), so no step looks at all pieces more than once.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:int>>")

    def width(piece: F.Column) -> F.Column:
        """Length without the mark between the groups, which no piece outside of a match has."""
        return F.length(piece) - F.when(piece.contains("\x02"), 1).otherwise(0)

    def add(state: F.Column, piece: F.Column) -> F.Column:
        end = state["at"] + width(piece)
        own = F.struct(state["at"].alias("start"), end.alias("end"), F.length(F.substring_index(piece, "\x02", -1)).alias("value"))
        return F.struct(end.alias("at"), F.when(piece.contains("\x02"), F.concat(state["spans"], F.array(own))).otherwise(state["spans"]).alias("spans"))

    def of_runs(runs: F.Column) -> F.Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, p: n + width(p)))
        begins = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
        of_run = lambda r, begin: F.aggregate(r, F.struct(begin.alias("at"), none.alias("spans")), add, lambda s: s["spans"])
        return F.flatten(F.zip_with(runs, begins, of_run))

    def of_pieces(pieces: F.Column) -> F.Column:
        run = F.greatest(F.lit(RUN), F.floor(F.sqrt(F.size(pieces))).cast("int"))
        cut = _let(run, lambda n: F.transform(F.sequence(F.lit(1), F.size(pieces), n), lambda a: F.slice(pieces, a, n)))
        return F.when(F.size(pieces) > 1, _let(cut, of_runs)).otherwise(none)

    return _let(F.split(F.regexp_replace(text, pattern, "\x01$1\x02$2\x01"), "\x01", -1), of_pieces)


def _joined(spans: F.Column) -> F.Column:
    """Spans as kind:start:end, by start and then kind, with commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _keys(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """With two hashes that stand for the row's id and text, which may be null."""
    return df.withColumns({"_k1": F.xxhash64(doc_id, text), "_k2": F.xxhash64(text, F.lit(7), doc_id)})


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, _k1, _k2 and `parts`: array<struct<start,kind,end>> of all parts, strong and weak (no text)."""
    rows = _keys(docs.select("doc_id", "text"), "doc_id", "text")
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), "\x01\x02", "\x03\x03")
    rows = rows.withColumns({n: _found(text, p) for n, p in (("f_assign", ASSIGN), ("f_access", ACCESS), ("f_hex", HEX), ("f_id", ID), ("f_email", EMAIL), ("f_endpoint", ENDPOINT))})

    def tagged(spans: F.Column, kind: str) -> F.Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    return rows.select(
        "doc_id",
        "_k1",
        "_k2",
        F.concat(
            tagged(F.filter("f_assign", lambda s: s["value"] >= 8), "assign"),
            tagged(F.filter("f_assign", lambda s: s["value"].between(4, 7)), "key"),
            tagged(F.col("f_access"), "access"),
            tagged(F.col("f_hex"), "hex"),
            tagged(F.col("f_id"), "id"),
            tagged(F.col("f_email"), "id"),
            tagged(F.col("f_endpoint"), "endpoint"),
        ).alias("parts"),
    )


def _linked(rows: DataFrame) -> DataFrame:
    """_k1, _k2 and `added`: the weak candidates that have their partners."""
    role = F.when(F.col("kind").isin(1, 3), "i").when(F.col("kind").isin(0, 2, 4), "s").otherwise("e")
    spans = rows.filter(F.size("parts") > 1).select("_k1", "_k2", F.explode("parts").alias("p")).select("_k1", "_k2", "p.*").distinct().withColumn("role", role)
    # A span reaches the bins from its start to its end; long ones reach several.
    bins = F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE)))
    held = spans.withColumn("bin", bins).groupBy("_k1", "_k2", "bin", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = spans.filter(F.col("kind") >= 3)
    near = weak.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / SCOPE) - 1, F.floor(F.col("end") / SCOPE) + 1)))
    met = near.alias("w").join(
        held.alias("h"),
        (F.col("w._k1") == F.col("h._k1"))
        & (F.col("w._k2") == F.col("h._k2"))
        & (F.col("w.bin") == F.col("h.bin"))
        & (F.col("w.role") != F.col("h.role"))
        & (F.col("h.first") <= F.col("w.end") + SCOPE)
        & (F.col("h.last") >= F.col("w.start") - SCOPE),
    )
    beside = lambda r: F.max(F.col("h.role") == r)
    met = met.groupBy("w._k1", "w._k2", "w.start", "w.kind", "w.end").agg(beside("i").alias("i"), beside("s").alias("s"))
    linked = met.filter(F.when(F.col("kind") == 3, F.col("s")).when(F.col("kind") == 4, F.col("i")).otherwise(F.col("i") & F.col("s")))
    return linked.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, _k1, _k2, base and spans (arrays of struct<start,kind,end>), a row for each row of docs."""
    rows, _ = common.materialize(parts(docs), "parts")
    base = F.filter("parts", lambda p: p["kind"] < 3)
    rows = rows.withColumn("base", base)
    return rows.join(_linked(rows), ["_k1", "_k2"], "left").select(
        "doc_id", "_k1", "_k2", "base", F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))).alias("spans")
    )


def _stretches(text: F.Column) -> F.Column:
    """The text in stretches of STRETCH code points, by way of pieces of 64 stretches (a substring is sought from the start)."""
    wide = 64 * STRETCH
    upto = lambda n, step: F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    pieces = F.transform(upto(F.length(text), wide), lambda a: F.substring(text, a + 1, F.lit(wide)))
    return F.flatten(F.transform(pieces, lambda p: F.transform(upto(F.length(p), STRETCH), lambda a: F.substring(p, a + 1, F.lit(STRETCH)))))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span (overlapping ones together) replaced by [kind]; n_chars follows the text. Other columns stay."""
    from pyspark.sql import Window

    found = find(docs).select("_k1", "_k2", "spans").filter(F.size("spans") > 0).dropDuplicates(["_k1", "_k2"])
    # Spans that begin before the end of an earlier one are part of it.
    earlier = Window.partitionBy("_k1", "_k2").orderBy("s.start", "s.kind", "s.end").rowsBetween(Window.unboundedPreceding, -1)
    each = found.select("_k1", "_k2", F.explode("spans").alias("s")).withColumn("from", F.coalesce(F.max("s.end").over(earlier), F.lit(0)))
    cut = F.when(F.col("s.start") >= F.col("from"), F.struct("from", F.col("s.start").alias("to"), F.col("s.kind").alias("kind")))
    spans = each.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.max("s.end").alias("at"))
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text = F.col("row.text")

    def between(parts: F.Column, a: F.Column, b: F.Column) -> F.Column:
        """The text from a up to b, out of its stretches."""
        first, last = F.floor(a / STRETCH).cast("int"), F.floor(b / STRETCH).cast("int")
        piece = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        head = F.substring(piece(first), a - first * STRETCH + 1, F.lit(STRETCH))
        tail = F.substring(piece(last), F.lit(1), b - last * STRETCH)
        inner = F.array_join(F.slice(parts, first + 2, last - first - 1), "")
        return F.when(first == last, F.substring(piece(first), a - first * STRETCH + 1, b - a)).otherwise(F.concat(head, inner, tail))

    def without(parts: F.Column) -> F.Column:
        pieces = F.transform("cuts", lambda c: F.concat(between(parts, c["from"], c["to"]), F.element_at(kinds, c["kind"] + 1)))
        return F.concat(F.array_join(pieces, ""), between(parts, F.col("at"), F.length(text)))

    rows = _keys(common.boxed(docs), "row.doc_id", "row.text").join(spans, ["_k1", "_k2"], "left")
    rows = rows.select("row", F.when(F.col("cuts").isNotNull(), _let(_stretches(text), without)).alias("clean"))
    new = F.col("row").withField("text", F.coalesce("clean", text))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return common.unboxed(rows.select(new.alias("row")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(common.documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == KINDS.index(k))).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )

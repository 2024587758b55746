r"""Secret scan with linking of multipart credentials.

Three base kinds are reported by themselves.  Weak parts (an account or key
identifier, a keyed value that alone proves nothing, an endpoint) are reported
only next to complementary parts of the same text: an identifier next to a
secret (weak or base), a weak secret next to an identifier, an endpoint next
to both.  Parts are next to each other if at most ``LINK_CHARS`` code points
lie between them, or at any distance in one scope: the innermost {object}, or
among parts whose line begins with them or their key, the block between blank
lines or the section from one [header] to the next.  Parts meet in a join on
(row, scope) or (row, cell of ``LINK_CHARS``), with one entry for each cell
that a part reaches.

A weak part must look like one: a secret has a digit, a sign or mixed case in
its value, or is quoted or assigned by ``=``; so has an identifier or a named
host, or it stands alone on its line (``user: Maria`` in a sentence is prose).

Only built-in DataFrame functions are used.  Texts are cut into pieces of
about ``PIECE_CHARS`` code points, at places that no pattern can match across:
after a line, or within a very long line between two words or after a closing
quote.  Work that grows with the square of its input stays within a piece.
Positions are code points: every match is put between two private-use marks
(texts that hold these characters get U+0001 in their place, which no pattern
matches), the piece is split at the marks and the lengths are added up.  A part
whose line began in an earlier piece is not the first on it.

Null texts count as empty.  Repeated rows are scanned row by row.  An empty
table gives an empty result.  The query reads only ``doc_id`` and ``text``;
the redacting stage leaves all other columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyho.llm.common import staged

LINK_CHARS = 200
_OPEN, _CLOSE = "\ue000", "\ue001"
REDACTED = "[SECRET]"

#: FIXED VALUES: base kinds, in order: name, pattern, group that is measured, least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: Weak parts: name, pattern.  Their order follows that of the base kinds.  Keys may
#: have a prefix that ends in any character but a letter or digit (aws_, DB_, x-).
WEAK = [
    ("id", r"""(?i)(?<![A-Za-z0-9])(client[_-]?id|access[_-]?key[_-]?id|account[_-]?id|user[_-]?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]{3,})"""),
    ("part", r"""(?i)(?<![A-Za-z0-9])((client[_-]?secret|secret[_-]?access[_-]?key|private[_-]?key|access[_-]?key|credentials?|passphrase|pass|pwd|auth|bearer)["']?\x20*[:=]\x20*["']?((bearer|basic)\x20+)?([A-Za-z0-9+/_.=-]{6,})|authorization["']?\x20*[:=]\x20*["']?(bearer|basic)\x20+[A-Za-z0-9+/_.=~-]+|bearer\x20+[A-Za-z0-9+/_.=~-]{6,})"""),
    ("endpoint", r"""(?i)(?<![A-Za-z0-9])([a-z][a-z0-9+.-]*://[^\s"'<>]{3,}|(host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9.-]{3,})"""),
]
KINDS = [k for k, *_ in BASE] + [k for k, *_ in WEAK]
#: What bounds scopes: name, pattern; numbered on from ``KINDS``.
BOUNDS = [("blank", r"\n(?:[\x20\t\r]*\n)++"), ("header", r"(?m)^[\x20\t]{0,99}\[[^\]\[\n]{1,200}\][\x20\t\r]*$"), ("open", r"\{"), ("close", r"\}")]
PIECE_CHARS = 4000
_LINE_END = r"\n(?:[\x20\t\r]*\n)*+"
#: Between two words, or after a quote that closes a value; no match holds either.
_MID_LINE = r"""(?<=[A-Za-z0-9])(?<!(?i:bearer|basic|export|set|env))\x20+(?=[A-Za-z0-9])|["'](?=[,}\]])"""
_PIECE = (rf"(?s).{{1,{PIECE_CHARS}}}(?:[^\n]{{0,999}}{_LINE_END}|[^\n]{{0,999}}\z"
          rf"|[^\n]{{1000}}.*?(?:{_LINE_END}|{_MID_LINE}|\z))")
#: What a weak part must hold to look like one, and which kinds may do so by standing alone on a line.
_LOOKS = {
    "id": r"""=|[:]\x20*["']|[0-9@_][^:=]*$""",
    "part": r"""(?i:^authorization)|=|[:]\x20*["'](?!(?i:bearer|basic))|(?i:^|[:]\x20*["']?|\x20)(?!(?i:bearer|basic)\x20)(?=[A-Za-z0-9+/_.~-]*([0-9+_]|[a-z][A-Z]))[A-Za-z0-9+/_.~-]{6,}$""",
    "endpoint": r"""://|=|[:]\x20*["']|[:]\x20*[a-zA-Z0-9-]*([0-9]|[.][a-zA-Z0-9])""",
}
_ALONE = ["id", "endpoint"]
_LINE = r"""(?:^|\n)[\x20\t"'{,*-]*(?:(?:export|set|env)\x20+)?[A-Za-z0-9_.-]*(?:["']?\x20*[:=]\x20*["']?)?$"""
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_PLACES = "array<struct<piece:int,at:int,line:boolean>>"
#: What a text must hold for a pattern to match, tested by plain search.
_HINT = {"assign": [":", "="], "access": ["AKIA"], "id": [":", "="], "part": [":", "="], "endpoint": [":", "="]}
#: The hex pattern as searched for: only runs that are long enough need marks.
_FIND = {"hex": r"[0-9a-f]{32,}"}


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind as an array of (start, kind, end)."""
    number = [*KINDS, *(b for b, _ in BOUNDS)].index(kind)
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "\u0001\u0001"),
                              F.lit(_FIND.get(kind, pattern)), F.lit(f"{_OPEN}$0{_CLOSE}"))
    pieces = F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)
    none = F.array().cast(_SPAN)

    def step(acc: Column, piece: Column) -> Column:
        """Every second piece is a match."""
        size = F.length(piece)
        fits = F.length(F.regexp_extract(piece, pattern, group)) >= least
        span = F.struct(acc.at.alias("start"), F.lit(number).alias("kind"), (acc.at + size).alias("end"))
        return F.struct(
            (acc.at + size).alias("at"), (~acc.inside).alias("inside"),
            F.when(acc.inside & fits, F.array_append(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("spans")),
                        step, lambda acc: acc.spans)
    there = text.rlike(_FIND.get(kind, pattern))
    if kind in _HINT:
        hint = F.lit(False)
        for h in _HINT[kind]:
            hint = hint | F.contains(text, F.lit(h))
        if kind == "part":
            hint = hint | F.contains(F.lower(text), F.lit("bearer"))
        there = hint & there
    return F.when(there, found).otherwise(none)


def _touching(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(text: Column) -> Column:
    return F.when(F.length(text) <= PIECE_CHARS, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)))


def _line_before(piece: Column, start: Column) -> Column:
    return F.substring_index(F.substring(piece, F.lit(1), start), "\n", -1)


def _base(piece: Column) -> Column:
    """All base spans of a piece by start, then kind."""
    return F.array_sort(F.concat(*[_matches(piece, *b) for b in BASE]))


def _weak(piece: Column, base: Column) -> Column:
    """Parts of a piece that look like parts and touch no base span."""
    def looks(kind: str, w: Column) -> Column:
        held = F.substring(piece, w.start + 1, w.end - w.start).rlike(_LOOKS[kind])
        if kind not in _ALONE:
            return held
        rest = F.substring_index(F.substring(piece, w.end + 1, F.length(piece)), "\n", 1)
        return held | (_line_before(piece, w.start).rlike(_LINE) & rest.rlike(r"""^["',;\x20\t\r]*$"""))

    found = F.concat(*[F.filter(_matches(piece, k, p, 0, 1), lambda w: looks(k, w)) for k, p in WEAK])
    return F.filter(found, lambda w: ~F.exists(base, lambda b: _touching(w, b)))


def found_spans(text: Column) -> Column:
    """For each piece of a text its ``size``, whether it ends a line, and its spans."""
    def found(piece: Column) -> Column:
        return _let(_base(piece), lambda base: F.struct(
            F.length(piece).alias("size"), F.endswith(piece, F.lit("\n")).alias("ends_line"),
            base.alias("base"), _weak(piece, base).alias("weak")))

    return F.transform(_pieces(text), found)


def _places(found: Column) -> Column:
    """For each piece its number, where it starts, and whether it starts a line."""
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("line"), F.array().cast(_PLACES).alias("list"))
    return F.aggregate(
        found, start,
        lambda acc, c: F.struct((acc.at + c.size).alias("at"), c.ends_line.alias("line"),
                                F.array_append(acc.list, F.struct(
                                    F.size(acc.list).alias("piece"), acc.at.alias("at"), acc.line.alias("line"))).alias("list")),
        lambda acc: acc.list)


def _moved(spans: Column, at: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(
        (s.start + at).alias("start"), s.kind.alias("kind"), (s.end + at).alias("end")))


def base_spans(found: Column) -> Column:
    """All base spans of a text by start, then kind."""
    return F.flatten(F.zip_with(found, _places(found), lambda c, o: _moved(c.base, o.at)))


def has_weak(found: Column) -> Column:
    return F.exists(found, lambda c: F.size(c.weak) > 0)


def scope_marks(text: Column, found: Column) -> Column:
    """All parts and scope bounds of texts with weak parts: ``start, kind, end, line, piece, at``."""
    def marks(piece: Column, c: Column) -> Column:
        def marked(p: Column, line: Column) -> Column:
            return F.struct((p.start + c.at).alias("start"), p.kind.alias("kind"), (p.end + c.at).alias("end"),
                            line.alias("line"), c.piece.alias("piece"), c.at.alias("at"))

        def begins(p: Column) -> Column:
            """Whether the part or its key is the first on its line."""
            known = c.line | F.contains(F.substring(piece, F.lit(1), p.start), F.lit("\n"))
            return known & _line_before(piece, p.start).rlike(_LINE)

        bounds = F.concat(*[_matches(piece, n, p, 0, 1) for n, p in BOUNDS])
        return F.concat(F.transform(c.spans, lambda p: marked(p, begins(p))),
                        F.transform(bounds, lambda p: marked(p, F.lit(False))))

    placed = F.zip_with(found, _places(found), lambda c, o: F.struct(
        F.concat(c.base, c.weak).alias("spans"), o.piece.alias("piece"), o.at.alias("at"), o.line.alias("line")))
    made = F.flatten(F.zip_with(_pieces(text), placed, marks))
    return F.when(has_weak(found), made)


def _keyed(marks: DataFrame) -> DataFrame:
    """The parts among ``marks`` with ``keys``: the cells and scopes they lie in."""
    blank, header, opened, closed = (len(KINDS) + i for i in range(len(BOUNDS)))
    kind = F.col("kind")
    so_far = Window.partitionBy("row_id").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("row_id", "level").orderBy("start", F.desc("kind"))
    back = Window.partitionBy("row_id", "level").orderBy(F.desc("start"), "kind")   # a frame that grows costs rows, one that shrinks their square

    def number(holds: Column) -> Column:
        return F.sum(holds.cast("long")).over(so_far)

    brace = F.when(kind.isin(opened, closed), F.struct("kind", "start"))
    cells = F.transform(F.sequence(F.floor(F.col("start") / LINK_CHARS), F.floor((F.col("end") + LINK_CHARS) / LINK_CHARS)),
                        lambda n: F.struct(F.lit("cell").alias("scope"), n.cast("long").alias("n")))

    def scope(name: str, holds: Column, n: Column) -> Column:
        return F.when(holds, F.array(F.struct(F.lit(name).alias("scope"), n.cast("long").alias("n")))).otherwise(
            F.array().cast("array<struct<scope:string,n:bigint>>"))

    return (marks.withColumn("block", number(kind.isin(blank, header))).withColumn("section", number(kind == header))
            .withColumn("level", number(kind == opened) - number(kind == closed) + (kind == closed).cast("long"))
            .withColumn("before", F.last(brace, True).over(level.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("after", F.last(brace, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
            .where(kind < blank)
            .select("row_id", "start", "kind", "end", "piece", "at", F.concat(
                cells, scope("block", F.col("line"), F.col("block")),
                scope("section", F.col("line") & (F.col("section") > 0), F.col("section")),
                scope("object", F.coalesce((F.col("before.kind") == opened) & (F.col("after.kind") == closed), F.lit(False)),
                      F.col("before.start"))).alias("keys")))


def linked_parts(rows: DataFrame) -> DataFrame:
    """The weak parts of ``rows`` (row_id, marks) whose complementary parts
    co-occur: ``row_id, start, kind, end`` and the number and start of their piece."""
    ident, part, endpoint = (KINDS.index(k) for k in ("id", "part", "endpoint"))
    access = KINDS.index("access")
    marks = rows.select("row_id", F.explode("marks").alias("p")).select("row_id", "p.*")
    parts = staged(_keyed(marks), "parts")
    weak = parts.where(F.col("kind") >= ident)
    role = F.when(F.col("kind").isin(ident, access), "id").when(F.col("kind") != endpoint, "secret")
    cell = F.col("key_b.scope") == "cell"
    near = (parts.select(F.col("row_id").alias("row_b"), role.alias("role_b"), "start", "end", F.explode("keys").alias("key_b"))
            .where("role_b is not null")
            .select("row_b", "role_b", "key_b", F.when(cell, F.col("start")).alias("start_b"), F.when(cell, F.col("end")).alias("end_b"))
            .distinct())   # one row a scope and role

    def beside(found: DataFrame, name: str) -> DataFrame:
        """The parts of ``found`` next to one of a role."""
        gap = F.greatest(F.col("start_b") - F.col("end"), F.col("start") - F.col("end_b"))
        meets = (F.col("row_id") == F.col("row_b")) & (F.col("key") == F.col("key_b")) & (F.coalesce(gap, F.lit(0)) <= LINK_CHARS)
        return (found.withColumn("key", F.explode("keys")).join(near.where(F.col("role_b") == name), meets, "left_semi")
                .drop("key").distinct())

    return (beside(weak.where(F.col("kind") == ident), "secret")
            .unionByName(beside(weak.where(F.col("kind") == part), "id"))
            .unionByName(beside(beside(weak.where(F.col("kind") == endpoint), "id"), "secret")).drop("keys"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def secrets_query(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    text = F.coalesce("text", F.lit(""))
    found = (docs.select("doc_id", text.alias("text"), found_spans(text).alias("found"))
             .select("doc_id", base_spans(F.col("found")).alias("base"),
                     scope_marks(F.col("text"), F.col("found")).alias("marks"))
             .withColumn("row_id", F.monotonically_increasing_id()))
    rows = staged(found, "secrets")   # written: row ids are fixed, spans found once
    linked = (linked_parts(rows.where("marks is not null")).groupBy("row_id")
              .agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked")))
    plain = rows.where("marks is null").withColumn("spans", F.col("base"))
    rows = plain.unionByName(rows.where("marks is not null").join(linked, "row_id", "left").withColumn(
        "spans", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))))).drop("linked"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")

    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
                       F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                       _joined(F.col("spans")).alias("spans"))


def _redacted(piece: Column, spans: Column) -> Column:
    """``piece`` with every run of touching spans replaced by one mark."""
    cut = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s.start >= acc.at, F.struct(
            s.end.alias("at"), F.concat(acc.out, F.array(
                F.substring(piece, acc.at + 1, s.start - acc.at), F.lit(REDACTED))).alias("out")))
        .otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out"))),
        lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(piece, acc.at + 1, F.length(piece))))
    return F.when(F.size(spans) > 0, cut).otherwise(piece)


def _with_redacted(text: Column, by_piece: Column) -> Column:
    """``text`` without the spans of its pieces."""
    return F.array_join(F.zip_with(_pieces(text), by_piece, _redacted), "")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span replaced, and ``n_chars`` (if any) to match.

    Only texts with weak parts, of which there are few, are written and joined
    with their links; all others are redacted where they are read.
    """
    names = docs.columns
    column = {c.lower(): c for c in names}
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    text = F.coalesce(F.col("doc")[column["text"]], F.lit(""))
    found = boxed.withColumn("found", found_spans(text))
    weak = staged(found.where(has_weak(F.col("found"))).withColumn("marks", scope_marks(text, F.col("found")))
                  .withColumn("row_id", F.monotonically_increasing_id()), "weak")
    linked = (linked_parts(weak.select("row_id", "marks"))
              .groupBy("row_id", "piece").agg(F.collect_list(F.struct(
                  (F.col("start") - F.col("at")).alias("start"), "kind", (F.col("end") - F.col("at")).alias("end"))).alias("spans"))
              .groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("piece", "spans"))).alias("linked")))

    def both(c: Column, n: Column, linked: Column) -> Column:
        more = F.element_at(linked, n)
        return F.array_sort(F.concat(c.base, F.coalesce(more, F.array().cast(_SPAN))))

    none = F.create_map().cast(f"map<int,{_SPAN}>")
    plain = found.where(~has_weak(F.col("found"))).select(
        "doc", F.transform("found", lambda c: c.base).alias("spans"))
    rows = plain.unionByName(weak.join(linked, "row_id", "left").withColumn("linked", F.coalesce("linked", none)).select(
        "doc", F.transform("found", lambda c, n: both(c, n, F.col("linked"))).alias("spans")))
    new = F.when(F.exists("spans", lambda s: F.size(s) > 0), _with_redacted(text, F.col("spans")))

    def out(c: str) -> Column:
        old = F.col("doc")[c]
        if c == column["text"]:
            return F.coalesce("new", old).alias(c)
        if c.lower() == "n_chars":
            kind = docs.schema[c].dataType
            return F.coalesce(F.when(old.isNotNull(), F.length("new")).cast(kind), old).alias(c)
        return old.alias(c)

    return rows.select("doc", new.alias("new")).select(*[out(c) for c in names])



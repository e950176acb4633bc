"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions alone.

A text's paragraphs are its lines, cut at spaces into pieces of at most 99 code points; a piece's digest is a 64-bit
hash, and a text is the set of its digests. A sketch has 24 cells in three tables; each digest enters one cell of each
(count, xor of digests, xor of their hashes). Every two versions' published sketches are subtracted cell by cell; cells that
hold one digest are peeled until all are empty, which gives the digests that only one version has. What fails is retried
larger: the counts left in the failed sketch estimate the difference, and both versions' digests are dealt to enough parts of
24 cells each for it; parts that don't peel are dealt to four times as many in each of three retries. Digests that even these
leave (level ``DIRECT`` of ``differences``) are compared directly.

The documents are dealt by ranges of (doc_id, hash of the text), so that a document's successor is in its own group or heads
the next; the ranges' bounds are a sample of at most about ``BOUNDS`` rows.

Edge cases: a null text is empty; two empty texts are alike (1.0); equal texts have equal fingerprints; rows with the
same doc_id follow each other by a hash of the text; a null doc_id comes last; an only document follows itself; very long
texts are read whole; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, sweep

#: A piece of text, and the cells of a digest k in the three tables.
PIECE = r"(?s)[^\n]{1,99}(?: |\n|$)|[^\n]{1,99}|\n"
_CELLS = ("pmod({k}, 8L)", "8L + pmod(shiftright({k}, 21), 8L)", "16L + pmod(shiftright({k}, 42), 8L)")
BOUNDS = 100_000
DIRECT = 9


def digests(text: str) -> Column:
    return F.expr(f"array_distinct(transform(regexp_extract_all({text}, r'{PIECE}', 0), x -> xxhash64(x)))")


def sketch(keys: str) -> Column:
    """The sketch of an array of digests: 24 cells (c, n, k, h), table by table; c is the bit of the cell's number. A digest's
    cell in a table is three of its bits."""
    one = "transform(array(filter({keys}, x -> x & {mask}L = {own}L)), m -> named_struct('c', {bit}L, 'n', bigint(size(m)), 'k', aggregate(m, 0L, (s, x) -> s ^ x), 'h', aggregate(m, 0L, (s, x) -> s ^ xxhash64(x))))"
    return F.expr("concat(" + ", ".join(one.format(keys=keys, c=c, bit=1 << c, mask=7 << 21 * (c // 8), own=c % 8 << 21 * (c // 8)) for c in range(24)) + ")")


def sketches(keys: DataFrame, *by: str) -> DataFrame:
    """by, cells: the sketch, without empty cells, of each group's digests k, each counted n times. The 72 numbers are plain
    columns, so that the sums are compiled: functions of arrays are interpreted digest by digest."""
    at = keys.select(*by, "n", "k", F.xxhash64("k").alias("h"), *[F.expr(cell.format(k="k")).alias(f"c{t}") for t, cell in enumerate(_CELLS)])
    sums = [F.expr(f"{f}(if(c{c // 8} = {c}L, {x}, 0L))").alias(f"{x}{c}") for c in range(24) for x, f in (("n", "sum"), ("k", "bit_xor"), ("h", "bit_xor"))]
    cells = ", ".join(f"named_struct('c', {1 << c}L, 'n', n{c}, 'k', k{c}, 'h', h{c})" for c in range(24))
    return at.groupBy(*by).agg(*sums).select(*by, F.expr(f"filter(array({cells}), x -> x.n <> 0 or x.k <> 0)").alias("cells"))


def subtract(a: str, b: str) -> Column:
    return F.expr(f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c, 'n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))")


def peel(cells: str, rounds: int = 6) -> Column:
    """(ok, found) after peeling an array of cells: it has worked (ok) if no cell is left; found are the digests k, with n = 1 if
    added and -1 if removed, their hashes h and the bits c of their cells. A step takes out all digests that are alone in a cell
    of one table, where no two are the same; a round is a step of each table, and a round without any is the last."""
    tables = ", ".join(f"{255 << 8 * t}L" for t in range(3))
    bits = " | ".join(f"shiftleft(1L, int({cell.format(k='x.k')}))" for cell in _CELLS)
    alone = f"transform(filter(s.cells, x -> abs(x.n) = 1 and x.c & t <> 0 and x.h = xxhash64(x.k)), x -> named_struct('n', x.n, 'k', x.k, 'h', x.h, 'c', {bits}))"
    without = "aggregate(q, x, (y, z) -> if(z.c & y.c <> 0, named_struct('c', y.c, 'n', y.n - z.n, 'k', y.k ^ z.k, 'h', y.h ^ z.h), y))"
    some = f"named_struct('cells', filter(transform(s.cells, x -> {without}), x -> x.n <> 0 or x.k <> 0), 'found', concat(s.found, q), 'idle', 0)"
    step = f"transform(array({alone}), q -> if(size(q) > 0, {some}, named_struct('cells', s.cells, 'found', s.found, 'idle', s.idle + 1)))[0]"
    return F.expr(
        f"""aggregate(flatten(array_repeat(array({tables}), {rounds})), named_struct('cells', filter({cells}, x -> x.n <> 0 or x.k <> 0), 'found', cast(array() as array<struct<n: bigint, k: bigint, h: bigint, c: bigint>>), 'idle', 0),
            (s, t) -> if(size(s.cells) = 0 or s.idle = 3, s, {step}), s -> named_struct('ok', size(s.cells) = 0, 'found', s.found))"""
    )


def with_next(docs: DataFrame, group_rows: int = 500) -> DataFrame:
    """doc_id, text, a (digests), sketch_a, and next, x, sketch_x: the same of the next document in descending doc_id, the last's
    being the first's. Texts are dealt once, by g, the number of bounds that aren't after their place."""
    place = F.struct("doc_id", "h")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    every = max(group_rows, docs.select("doc_id").count() // BOUNDS)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "h", F.lit(29)), F.lit(every)) == 0)
    bounds = drawn.agg(F.array_sort(F.collect_set(place)).alias("b")).select(F.struct("b", F.filter("b", lambda _, i: i % 100 == 0).alias("tops")).alias("s"))
    dealt = rows.withColumn("s", bounds.scalar()).withColumn("p", place).withColumn("t", F.expr("size(filter(s.tops, c -> c <= p))"))
    g = F.expr("if(t = 0, 0, (t - 1) * 100 + size(filter(slice(s.b, (t - 1) * 100 + 1, 100), c -> c <= p)))")
    dealt = dealt.select(g.alias("g"), "doc_id", "h", "text")
    heads = dealt.groupBy("g").agg(F.max_by("text", place).alias("head"))
    ids = heads.select("g")  # one row per group
    w = Window.orderBy(F.desc("g"))
    follow = ids.select("g", F.coalesce(F.lead("g").over(w), F.max("g").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("ng"))
    head = follow.join(heads.withColumnRenamed("g", "ng"), "ng").select("g", "head").withColumn("head_keys", digests("head"))
    head = head.select("g", F.struct(F.col("head").alias("text"), F.col("head_keys").alias("a"), sketch("head_keys").alias("sketch_a")).alias("head"))
    sketched = dealt.repartition("g").withColumn("a", digests("text")).withColumn("sketch_a", sketch("a"))
    order = Window.partitionBy("g").orderBy(F.desc("doc_id"), F.desc("h"))
    out = sketched.withColumn("next", F.lead(F.struct("text", "a", "sketch_a")).over(order)).join(head, "g").withColumn("next", F.coalesce("next", "head"))
    return out.select("doc_id", "text", "a", "sketch_a", F.col("next.text").alias("next"), F.col("next.a").alias("x"), F.col("next.sketch_a").alias("sketch_x"))


def edited(docs: DataFrame) -> DataFrame:
    """with_next and the edited text: the last floor(n / 2) code points replaced by the first as many of the next; e, sketch_e of it."""
    change = F.expr("concat(substring(text, 1, length(text) - length(text) div 2), substring(next, 1, int(length(text) div 2)))")
    out = with_next(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), change.alias("edited"), "a", "sketch_a", "x", "sketch_x")
    return out.withColumn("e", digests("edited")).withColumn("sketch_e", sketch("e"))


def first_try(df: DataFrame, b: str) -> DataFrame:
    """df with d_b and est_b of the published sketches of a and b: the digests that differ if they peel, else null; and an estimate
    of how many: in a table of 8 cells the squares of the counts add up to 7/8 of them and 1/8 of the squared sum, on average."""
    est = f"greatest(1L, bigint(abs(size(a) - size({b}))), bigint((aggregate(_cells, 0L, (s, x) -> s + x.n * x.n) * 8 / 3 - pow(size(a) - size({b}), 2)) / 7))"
    out = df.withColumn("_cells", subtract("sketch_a", f"sketch_{b}")).withColumn("_peeled", peel("_cells"))
    found = F.expr("if(_peeled.ok, bigint(size(_peeled.found)), null)")
    return out.withColumn(f"d_{b}", found).withColumn(f"est_{b}", F.expr(est)).drop("_cells", "_peeled", f"sketch_{b}")


def _part(keys: str, parts: str) -> str:
    return f"pmod(xxhash64({keys}, 17), {parts})"


def larger(left: DataFrame) -> DataFrame:
    """One larger sketch of each pair of versions: left has row, tag, parts, a, b; returns row, tag, parts, d, a, b with d digests
    recovered and a, b the digests of parts that didn't peel. The only shuffle deals left by row."""
    dealt = left.repartition("row")
    keys = dealt.select("row", "tag", "parts", F.size("a").alias("na"), F.posexplode(F.concat("a", "b")).alias("i", "k"))
    keys = keys.select("row", "tag", F.expr(_part("k", "parts")).alias("part"), "k", F.expr("if(i < na, 1L, -1L)").alias("n"))
    peeled = sketches(keys, "row", "tag", "part").select("row", "tag", "part", peel("cells").alias("p"))
    got = peeled.groupBy("row", "tag").agg(F.sum(F.expr("if(p.ok, size(p.found), 0)")).alias("d"), F.collect_list(F.expr("if(p.ok, null, part)")).alias("failed"))
    out = dealt.join(got, ["row", "tag"], "left")  # no digest at all: both are empty
    rest = lambda x: F.expr(f"if(size(failed) > 0, filter({x}, k -> array_contains(failed, {_part('k', 'parts')})), array())").alias(x)
    return out.select("row", "tag", "parts", F.coalesce("d", F.lit(0)).cast("long").alias("d"), rest("a"), rest("b"))


def differences(base: DataFrame, retries: int = 3, load: int = 6) -> DataFrame:
    """row, tag, d, level: digests that only one of base's a and e (tag 0) or a and x (tag 1) holds, as found at each level: 0 by
    the published sketches, 1 to ``retries`` by larger ones, ``DIRECT`` without a sketch. A pair's d is the sum over its levels."""
    first = None
    for tag, b in enumerate(("e", "x")):
        part = base.select("row", F.lit(tag).alias("tag"), "a", F.col(b).alias("b"), F.col(f"d_{b}").alias("d"), F.col(f"est_{b}").alias("est"))
        first = part if first is None else first.unionByName(part)
    parts = F.expr(f"greatest(2L, bigint(pow(2, ceil(log2(est / {load}D)))))")
    done, left = [first.where("d is not null").select("row", "tag", "d", F.lit(0).alias("level"))], first.where("d is null").select("row", "tag", parts.alias("parts"), "a", "b")
    for k in range(retries):
        got = staged(larger(left), "peeled")
        sweep(base.sparkSession)
        done.append(got.select("row", "tag", "d", F.lit(k + 1).alias("level")))
        left = got.where("size(a) + size(b) > 0").select("row", "tag", (F.col("parts") * 4).alias("parts"), "a", "b")
    done.append(left.select("row", "tag", F.expr("bigint(size(array_except(a, b)) + size(array_except(b, a)))").alias("d"), F.lit(DIRECT).alias("level")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def serialised(cells: str) -> Column:
    return F.expr(f"array_join(transform({cells}, x -> if(x.n = 0 and x.k = 0, '', concat(x.n, ':', hex(x.k), ':', hex(x.h)))), ';')")


def compared(docs: DataFrame) -> DataFrame:
    """Staged, a row per document: row, doc_id, n_chars, edited_sha256, digests a, e, x and what the published sketches say of their differences."""
    base = first_try(first_try(edited(docs), "e"), "x")
    base = base.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "e", F.size("x").alias("nx"), F.expr("if(d_x is null, x, null)").alias("x"), "d_e", "est_e", "d_x", "est_x")
    return staged(base.withColumn("row", F.monotonically_increasing_id()), "digests")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    base = compared(docs)
    sweep(docs.sparkSession)  # the shuffled texts
    near = differences(base).groupBy("row").agg(F.sum(F.expr("if(tag = 0, d, 0)")).alias("d_e"), F.sum(F.expr("if(tag = 1, d, 0)")).alias("d_x"))
    both = base.select("row", "doc_id", "n_chars", "edited_sha256", "a", "e", "nx").join(near, "row")
    out = both.select("doc_id", "n_chars", "edited_sha256", sketch("a").alias("sa"), sketch("e").alias("se"), F.size("a").alias("na"), F.size("e").alias("ne"), "nx", "d_e", "d_x")
    out = out.select("*", serialised("sa").alias("fingerprint"), serialised("se").alias("edited_fingerprint"))

    def like(n: str, d: str) -> Column:
        return F.expr(f"if(na + {n} = 0, 1.0D, 1.0D - double({d}) / (na + {n}))")

    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("ne", "d_e").alias("near_edited"), like("nx", "d_x").alias("near_next"))

"""Line deduplication by winnowing over line hashes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _lines(text: str = "text") -> str:
    return f"split(coalesce({text}, ''), '\\n')"


def _trimmed(x: str = "x") -> str:
    return f"trim(BOTH ' \\t\\r' FROM {x})"


def _starts(size: str, continues: str) -> str:
    """The first of each stretch of the places 0 to ``size`` - 1; ``continues`` tells whether place i goes on from max(i - 1, 0)."""
    return f"filter(sequence(0, {size} - 1), i -> i = 0 or not ({continues}))"


def _ends(starts: str, size: str) -> str:
    return f"concat(slice({starts}, 2, size({starts})), array({size}))"


def _places(base: DataFrame, run: int) -> DataFrame:
    """(rid, doc_id, print, p, full): the selected places of every row of at least ``run`` non-blank lines.

    Each window of ``run`` lines selects its rightmost least line hash, the print; windows that
    follow each other and select the same place are one row: the first of them is ``p``, and
    ``full`` are the digests of the windows, which reach to both sides of the place.
    """
    words = F.expr(f"filter(transform({_lines()}, x -> {_trimmed()}), x -> x != '')")
    rows = base.select("rid", "doc_id", words.alias("l")).where(F.size("l") >= run)
    rows = rows.select("rid", "doc_id", F.expr("transform(l, x -> xxhash64(x))").alias("h"), F.expr("transform(l, x -> md5(x))").alias("m"))
    rows = rows.withColumn("n", F.size("h") - (run - 1))

    def at(p: str) -> str:
        parts = [f"named_struct('h', h[{p} + {j}], 'j', {-j})" for j in range(run)]
        return f"{p} - least({', '.join(parts)}).j" if run > 1 else p

    rows = rows.withColumn("a", F.expr(_starts("n", f"{at('i')} = {at('greatest(i - 1, 0)')}")))
    lines = ", ".join(f"m[q + {j}]" for j in range(run))
    full = f"transform(sequence(s, e - 1), q -> unhex(md5(concat({lines}))))"
    place = f"named_struct('print', h[{at('s')}], 'p', s, 'full', {full})"
    rows = rows.select("rid", "doc_id", F.expr(f"explode(zip_with(a, {_ends('a', 'n')}, (s, e) -> {place}))").alias("w"))
    return rows.select("rid", "doc_id", "w.print", "w.p", "w.full")


def _keyed(rows: DataFrame, keys: DataFrame, names: list[str], heavy: int) -> DataFrame:
    """Written ``rows`` joined with ``keys``, one row a key with the number ``n`` of rows that have it.

    A key of more than one in ``heavy`` rows, of which there are fewer than ``heavy``, is broadcast, so its
    rows stay spread over their tasks; the rows of all other keys are exchanged.
    """
    bound = rows.count() / heavy
    frequent = F.broadcast(keys.where(F.col("n") > bound))
    rest = rows.join(frequent, names, "left_anti").join(keys.where(F.col("n") <= bound), names)
    return rows.join(frequent, names).unionByName(rest).drop("n")


def _matches(places: DataFrame, run: int, heavy: int) -> DataFrame:
    """(rid, runs): the maximal repeated runs of each row that has any, each with the earlier place it repeats.

    Places whose print occurs once cannot match.  The others meet by print and are extended
    to both sides, as far as their windows reach: a window meets the first with its print and
    digest, counted by key before joining, so that a line that stands in a third of all
    documents does not meet itself in pairs.  Windows that follow each other in the row and in
    the earlier one are one run, so a match goes on through the places behind and before it.
    """
    prints = places.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = _keyed(places, store.written(prints, "prints"), ["print"], heavy)
    met = met.select("rid", "doc_id", "print", "p", F.posexplode("full").alias("k", "full"))
    met = store.written(met.select("rid", "doc_id", "print", (F.col("p") + F.col("k")).alias("p"), "full"), "windows")
    place = F.struct("doc_id", "rid", "p")
    first = met.groupBy("print", "full").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    later = _keyed(met, store.written(first, "first"), ["print", "full"], heavy).where(place > F.col("first"))
    pairs = later.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("p", "first"))).alias("m"))
    before = "m[greatest(i - 1, 0)]"
    follows = f"m[i].p = {before}.p + 1 and m[i].first.rid = {before}.first.rid and m[i].first.p = {before}.first.p + 1"
    pairs = pairs.select("rid", "m", F.expr(_starts("size(m)", follows)).alias("a"))
    one = f"named_struct('start', m[s].p, 'lines', e - s + {run - 1}, 'of_doc_id', m[s].first.doc_id, 'of_start', m[s].first.p)"
    return pairs.select("rid", F.expr(f"zip_with(a, {_ends('a', 'size(m)')}, (s, e) -> {one})").alias("runs"))


def line_dedup(docs: DataFrame, run: int = 3, keep_text: bool = False, keep_runs: bool = False, heavy: int = 1000) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every row of ``docs(doc_id, text)``.

    Lines end at a line feed; surrounding white space does not count, and blank lines are
    neither compared nor removed.  A run of ``run`` or more consecutive non-blank lines
    that already occurs at an earlier place, by (doc_id, row, line), is removed; the
    first occurrence stays, and with ``run`` 1 every later occurrence of a line goes, alone
    or in a run of any length.  ``kept_sha256`` is over the remaining original lines, joined
    by line feeds; with ``keep_text`` they are returned, with ``keep_runs`` the runs that go:
    (start, lines, of_doc_id, of_start), counted in non-blank lines.  Null and empty texts have
    one blank line.  Of repeated rows the first stays; null doc_ids come first.

    Windows select their least line hash as fingerprint (every repeated run shares one),
    repeated fingerprints join their places, and matches are extended both ways.  Fingerprints
    and windows of more than one in ``heavy`` places are joined without an exchange.
    """
    base = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    base = store.written(base, "lines")
    places = store.written(_places(base, run), "places")
    # numbers of the lines that go, from the runs' places among the non-blank ones; these are bound once a row
    filled = f"filter(transform({_lines()}, (x, i) -> if({_trimmed()} != '', i, null)), i -> i is not null)"
    gone = f"flatten(transform(array({filled}), f -> flatten(transform(runs, r -> slice(f, r.start + 1, r.lines)))))"
    matches = _matches(places, run, heavy)
    out = base.join(matches, "rid", "left").withColumn("dead", F.expr(f"if(runs is null, null, sort_array(array_distinct({gone})))"))

    # one flag a line from the sorted places, so that a text of many lines takes time in proportion
    gap = "(a, b) -> concat(if(a >= 0, array(true), cast(array() as array<boolean>)), array_repeat(false, b - a - 1))"
    flags = f"flatten(zip_with(concat(array(-1), dead), concat(dead, array(size({_lines()}))), {gap}))"
    marked = f"filter(zip_with({_lines()}, {flags}, (x, gone) -> named_struct('x', x, 'gone', gone)), s -> not s.gone)"
    kept = F.expr(f"if(dead is null, {_lines()}, transform({marked}, s -> s.x))")
    out = out.withColumn("kept", kept)
    text = F.array_join("kept", "\n")
    none = f"cast(array() as {matches.schema['runs'].dataType.simpleString()})"
    return out.select(
        "doc_id",
        F.size(F.expr(_lines())).cast("long").alias("n_lines"),
        F.coalesce(F.size("dead"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(text, 256).alias("kept_sha256"),
        *([text.alias("kept_text")] if keep_text else []),
        *([F.coalesce("runs", F.expr(none)).alias("runs")] if keep_runs else []),
    )

"""Line dedup across documents: a segment-partition edit join on distinct lines, with built-in expressions only.

Lines with a word take part; others stay as they are. Two lines are linked if they are equal, or their edit distance is at
most EDITS and at most one for PER code points of the shorter one. Linked lines form classes (components); of each class
the first occurrence, by doc_id and place in the text, stays and all others go.

Filter: a line is taken as e + 1 disjoint regions, e being the edits that its length allows. Of two linked lines one region
is left alone by all edits, with no more edits before it than regions before it and no more after it than regions after
it; so it lies near its place as counted from the closer end. Regions have the size that fits the shortest line of a class
of lengths (WIDTH long), so lines of one class have the same ones whatever their length, and a line only takes part in the
classes of the shorter lines that it may be linked with: five keys a line, about, each a hash of a window. Lines are
compared only under common keys. A key and the hash of its line is all that is shuffled, once, whatever the size; lines
that occur very often give keys at their first occurrence only. Lines that share a region but differ elsewhere (variants
of one line) are parted by the place where they leave a common pivot, see links.py; those that leave it at the same place
are compared by how often they hold each letter before their texts are, since an edit changes two such counts at most.

Verify: the common prefix and suffix are cut off by halving steps; on what remains the edit distance is computed along
a band of 2 * EDITS + 1 diagonals whose differences are kept as bits of one integer each, one step per character.

Defined results: null and empty texts have no lines to drop and stay; rows with equal doc_id and text are one document
(what goes, goes from each); null doc_id comes first in the order; a document that loses all its lines with words is
left out of `clean` and has an empty text in `digest`; an empty table gives an empty result; further columns are kept
by `clean` and ignored by `digest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import Staging, has_word
from orrery.llm.links import link

EDITS = 2
#: One edit for so many characters of the shorter line.
PER = 12
#: Cells of the grid over the places of a pivot, on each side.
GRID = 16
#: Lengths of a class of lines; more than any number of edits.
WIDTH = 16
#: Letters that are counted in variants of a line, each by itself; all other characters count together.
LETTERS = "etaoinshrdlucmwfgypb "
#: Lines that occur so often give their keys once.
HOT = 256
#: Hashes up to this number are broadcast; more are joined by shuffling, from SPREAD times as many on without a table of bits.
BROADCAST_IDS, SPREAD = 2_000_000, 16


def windows(e: int) -> tuple[int, list[tuple[int, bool, int, int]]]:
    """The spare characters of a line for e edits, and its windows: (region, from the end, windows' sizes before it, characters before it).

    Region i may be moved by min(i, e - i) characters at most, counted from the closer end, and is longer than its window by as
    many; so a window of one line, on the region's first places in either, is in the other line's region as well.
    """
    room = [min(i, e - i) for i in range(e + 1)]
    out = []
    for i in range(e + 1):
        back = 2 * i > e
        before = range(i + 1, e + 1) if back else range(i)
        out += [(i, back, len(before), sum(room[j] for j in before) + t) for t in range(room[i] + 1)]
    return sum(room), out


def keyed(lines: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """(key, h): the keys of lines (h, line, n characters)."""
    allowed = lambda a: F.least(F.lit(edits), F.floor(a / per)).cast("int")
    least = max(per, (edits + 1) ** 2)
    # As the shorter line itself, or one longer by `s` characters, if that is another class.
    own = lines.where(F.col("n") >= least).select("h", "line", "n", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("s")).withColumn("a", F.col("n") - F.col("s"))
    other = (F.floor(F.col("a") / WIDTH) != F.floor((F.col("a") + 1) / WIDTH)) | (allowed(F.col("a")) != allowed(F.col("a") + 1))
    own = own.where((F.col("a") >= least) & ((F.col("s") == 0) | other))
    own = own.select("h", "line", "n", allowed(F.col("a")).alias("e"), F.floor(F.col("a") / WIDTH).cast("int").alias("w"))
    # The shortest line of the class.
    base = F.greatest(F.lit(least), F.col("w") * WIDTH, F.col("e") * per)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("k"))
    cases = []
    for e in range(1, edits + 1):
        spare, places = windows(e)
        size = F.floor((base - spare) / (e + 1)).cast("int")
        region, back, sizes, chars = zip(*places)
        before = pick(sizes) * size + pick(chars)
        cases.append((e, len(places), F.struct(pick(region).alias("region"), F.when(pick(back), F.col("n") - before - size).otherwise(before).alias("start"), size.alias("size"))))
    number, where = F.lit(cases[-1][1]), cases[-1][2]
    for e, m, place in cases[:-1]:
        number, where = F.when(F.col("e") == e, m).otherwise(number), F.when(F.col("e") == e, place).otherwise(where)
    each = own.select("h", "line", "n", "e", "w", F.explode(F.sequence(F.lit(0), number - 1)).alias("k")).withColumn("p", where)
    return each.select(F.xxhash64("e", "w", "p.region", F.substring(F.col("line"), F.col("p.start") + 1, F.col("p.size"))).alias("key"), "h")


def within(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether the edit distance of two different strings, in the columns a and b, is at most `edits`."""
    e, width = edits, 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (2 * edits)
    # Length of the common prefix of r.a and r.b: steps that halve, each taken if the next characters agree.
    hops = "transform(sequence(0, cast(floor(log2(greatest(1, least(length(r.a), length(r.b))))) as int)), i -> cast(power(2, i) as int))"
    prefix = f"aggregate(reverse({hops}), 0, (p, s) -> if(p + s <= least(length(r.a), length(r.b)) and substring(r.a, p + 1, s) = substring(r.b, p + 1, s), p + s, p))"
    rest = f"transform(transform({{rows}}, r -> struct(r.a as a, r.b as b, {prefix} as p)), r -> struct(reverse(substring(r.a, r.p + 1, length(r.a))) as a, reverse(substring(r.b, r.p + 1, length(r.b))) as b))"
    core = rest.format(rows=rest.format(rows=f"array(struct({a} as a, {b} as b))"))
    # Column j of the band: bit i is row j - e + i. vp, vn: vertical differences; d0: zero diagonals; hp, hn: horizontal ones.
    match = " | ".join(f"if(j - {e} + {i} between 1 and m.m and get(m.x, j - {e} + {i} - 1) = get(m.y, j - 1), {1 << i}L, 0L)" for i in range(width))
    step = f"""
        transform(transform(transform(array(struct({match} as pm)),
            q -> struct(((((q.pm & t.vp) + t.vp) ^ t.vp) | q.pm | t.vn) & {full}L as d0)),
            q -> struct(q.d0 as d0, (t.vn | ~(q.d0 | t.vp)) & {full}L as hp, q.d0 & t.vp as hn)),
            q -> named_struct(
                'vp', (q.hn | ~(shiftright(q.d0, 1) | q.hp)) & {full}L,
                'vn', shiftright(q.d0, 1) & q.hp,
                'd', cast(t.d + if(j + {e} <= m.m, if(q.d0 & {top}L = 0L, 1, 0), if(m.m - j + {e} < 0, 0,
                     cast(shiftright(q.hp, m.m - j + {e}) & 1L as int) - cast(shiftright(q.hn, m.m - j + {e}) & 1L as int))) as int)))[0]"""
    start = f"named_struct('vp', {(full >> e) << e}L, 'vn', 0L, 'd', {e})"
    # Within the band a distance falls by at most 2 * e on the way to its end, so beyond 3 * e the rest is skipped.
    band = f"aggregate(sequence(1, m.n), {start}, (t, j) -> if(t.d > {3 * e + 1}, t, {step}), t -> t.d)"
    return F.expr(f"""
        transform(transform({core}, r -> named_struct('m', length(r.a), 'n', length(r.b), 'x', split(r.a, ''), 'y', split(r.b, ''))),
            m -> case when abs(m.m - m.n) > {e} then false when greatest(m.m, m.n) <= {e} then true
                 when m.m <= {e} then levenshtein(array_join(m.x, ''), array_join(m.y, '')) <= {e}
                 else {band} <= {e} end)[0]""")


def _reach(a: str, b: str, edits: int) -> str:
    """array(p, r) as SQL: the length of the common prefix of columns a and b, and how far into a some prefix of b goes
    within `edits` edits. On each diagonal the furthest place after one more edit comes from three places before it.
    """
    steps = lambda i, j: f"aggregate(r.hops, 0, (p, s) -> if({i} + p + s <= r.m and {j} + p + s <= r.n and substring(r.a, {i} + p + 1, s) = substring(r.b, {j} + p + 1, s), p + s, p))"
    # On most diagonals the very next characters differ.
    same = lambda i, j: f"if(substring(r.a, {i} + 1, 1) = substring(r.b, {j} + 1, 1), {steps(i, j)}, 0)"
    hops = f"reverse(transform(sequence(0, cast(floor(log2(greatest(1, least(length({a}), length({b}))))) as int)), i -> cast(power(2, i) as int)))"
    held = "'a', r.a, 'b', r.b, 'm', r.m, 'n', r.n, 'hops', r.hops"
    state = f"transform(array(named_struct('a', {a}, 'b', {b}, 'm', length({a}), 'n', length({b}), 'hops', {hops})), r -> named_struct({held}, 'p', {same(0, 0)}))"
    state = f"transform({state}, r -> named_struct({held}, 'p', r.p, 'f', array(r.p)))"
    for e in range(1, edits + 1):
        at = lambda d: f"r.f[{d + e - 1}]"  # noqa: B023, E731
        starts = []
        for d in range(-e, e + 1):
            before = [at(d) + " + 1"] * (abs(d) < e) + [at(d + 1) + " + 1"] * (abs(d + 1) < e) + [at(d - 1)] * (abs(d - 1) < e)
            starts.append(before[0] if len(before) == 1 else f"greatest({', '.join(before)})")
        state = f"transform({state}, r -> named_struct({held}, 'p', r.p, 'f', array({', '.join(starts)})))"
        state = f"transform({state}, r -> named_struct({held}, 'p', r.p, 'f', transform(r.f, (i, k) -> least(r.m, i + {same('i', f'(i + k - {e})')}))))"
    return f"transform({state}, r -> array(r.p, array_max(r.f)))[0]"


def _differences(stage: Staging, pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(key, cid, ...): cells of the places where each line leaves its pivot, from the front and from the back.

    A line leaves its pivot after their common prefix (low), and is away for good where no prefix of it is within `edits`
    edits of the pivot any more (high). Of two linked lines, the one that stays longer equals the pivot up to its own low,
    so the other one is within the edits of the pivot up to there: the ranges from low to high overlap. So do those from
    the back. Rows are cells of a grid over both ranges; a pair counts in the first cell that it has in common.
    The counts of letters go along: one edit changes two of them by one, at most.
    """
    tx = texts.select("cid", "line")
    tp = texts.select(F.col("cid").alias("pivot"), F.col("line").alias("pivot_line"))
    both = pairs.join(tx, "cid").join(tp, "pivot").select("pivot", "cid", "line", "pivot_line", F.reverse("line").alias("back"), F.reverse("pivot_line").alias("pivot_back"))
    ends = both.select("pivot", "cid", F.expr(f"greatest(8, length(pivot_line) div {GRID} + 1)").cast("int").alias("w"), F.expr(_reach("pivot_line", "line", edits)).alias("f"), F.expr(_reach("pivot_back", "back", edits)).alias("b"), _letters(F.col("line")).alias("bag"))
    ends = stage.keep(ends).select("pivot", "cid", "w", "bag", *[F.get(c, F.lit(k)).alias(n) for n, c, k in (("f0", "f", 0), ("f1", "f", 1), ("b0", "b", 0), ("b1", "b", 1))])
    cells = ends.withColumn("fc", F.expr("explode(sequence(cast(f0 div w as int), cast(f1 div w as int)))")).withColumn("bc", F.expr("explode(sequence(cast(b0 div w as int), cast(b1 div w as int)))"))
    return cells.select(F.xxhash64("pivot", "fc", "bc").alias("key"), "cid", "w", "f0", "f1", "b0", "b1", "fc", "bc", "bag")


def _letters(line: Column) -> Column:
    """How often each of LETTERS is in a line, and then all other characters together."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS]
    return F.array(*counts, F.length(F.translate(line, LETTERS, "")))


def meet(edits: int) -> str:
    """Whether two rows of `_differences` may be linked and meet here first, as SQL over columns with _x and _y."""
    places = "f0_x <= f1_y and f0_y <= f1_x and b0_x <= b1_y and b0_y <= b1_x and fc_x = greatest(f0_x, f0_y) div w_x and bc_x = greatest(b0_x, b0_y) div w_x"
    return f"{places} and {' + '.join(f'abs(bag_x[{k}] - bag_y[{k}])' for k in range(len(LETTERS) + 1))} <= {2 * edits}"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, rid2, pos, line, h, g) of the lines with a word; rid, rid2 tell documents apart, h, g lines (128 bits each)."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # The ids before the lines: beside posexplode they would be hashed anew, from the whole text, for each line.
    d = d.select("doc_id", "text", *_rid(F.col("text")))
    d = d.select("doc_id", "rid", "rid2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.where(has_word(F.col("line"))).withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line"))


def _rid(text: Column) -> list[Column]:
    return [F.xxhash64("doc_id", text).alias("rid"), F.xxhash64(F.lit(1), F.col("doc_id"), text).alias("rid2")]


def _cid() -> Column:
    """A line by all its bits."""
    return F.concat(F.hex("h"), F.lit(":"), F.hex("g"))


def _at() -> Column:
    """A place (doc_id, pos) as one number: in that order, null doc_id first."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(19,0)"))
    return doc * F.lit(2**32).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")


def _maybe(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows without most of those whose h is not among the n staged ids: by a table of eight bits for each of them, broadcast up to a bound."""
    if n > SPREAD * BROADCAST_IDS:
        return rows
    words = 1 << max(0, n - 1).bit_length()  # of 64 bits each; eight ids share one
    words = max(1, words // 8)
    word, bit = (lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1))), "cast({h} & 63 as int)"
    table = ids.groupBy(word(F.col("h")).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit.format(h='h')})")).alias("bits"))
    found = rows.withColumn("word", word(F.col("h"))).join(F.broadcast(table), "word").where(F.expr(f"shiftright(bits, {bit.format(h='h')}) & 1L = 1L"))
    return found.drop("word", "bits")


def _by_ids(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose `columns` (with h) are among staged ids: broadcast up to a bound, joined by shuffling beyond."""
    n = ids.count()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), columns, "left_semi")
    return _maybe(rows, ids, n).join(ids, columns, "left_semi")


def classes(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """(h, g, label, n, at): each distinct line's hashes, class, occurrences and first occurrence (see _at), staged.

    Only lines that occur twice or more, or share a key with another line, are listed.
    """
    stage = Staging(docs.sparkSession, "lines")
    lines = _lines(docs)
    repeated = stage.keep(lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(_at()).alias("at")).where("n > 1"))
    often = stage.keep(repeated.where(F.col("n") >= HOT).select("h", "g", F.col("at").alias("first")))
    once = lines.select("h", "g", "line", "doc_id", "pos")
    if not often.isEmpty():
        once = once.join(F.broadcast(often), ["h", "g"], "left").where(F.col("first").isNull() | (F.col("first") == _at()))
    keys, under = keyed(once.select("h", "line", F.length("line").alias("n")), edits, per), Window.partitionBy("key")
    # One shuffle for both; that two lines under one key agree in h by chance is beyond all odds.
    found = stage.keep(keys.select("key", "h", F.min("h").over(under).alias("a"), F.max("h").over(under).alias("b")).where("a < b").select("key", "h").distinct())
    members = stage.keep(found.select("h").distinct())
    texts = _by_ids(lines.select("h", "g", "line", "doc_id", "pos"), members, ["h"])
    texts = texts.groupBy("h", "g").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n"), F.min(_at()).alias("at"))
    texts = stage.keep(texts.withColumn("cid", _cid()))
    shared = stage.keep(found.join(texts.select("h", "cid"), "h").select("key", "cid"))

    def confirm(pairs: DataFrame) -> DataFrame:
        tx = texts.select(F.col("cid").alias("x"), F.col("line").alias("tx"))
        ty = texts.select(F.col("cid").alias("y"), F.col("line").alias("ty"))
        both = pairs.join(tx, "x").join(ty, "y").where(F.abs(F.length("tx") - F.length("ty")) <= edits)
        shorter, near = F.least(F.length("tx"), F.length("ty")), within("tx", "ty", edits)
        for e in range(edits - 1, 0, -1):
            near = F.when(shorter < (e + 1) * per, within("tx", "ty", e)).otherwise(near)
        return both.where(near).select("x", "y")

    labels = link(stage, shared, texts.select("cid"), confirm, lambda pairs: _differences(stage, pairs, texts, edits), meet(edits))
    known = labels.join(texts.select("cid", "h", "g", "n", "at"), "cid").select("h", "g", "label", "n", "at")
    others = repeated.join(texts.select("h", "g"), ["h", "g"], "left_anti").select("h", "g", _cid().alias("label"), "n", "at")
    out = stage.keep(known.unionByName(others))
    stage.drop(repeated, often, found, members, shared, texts, labels)
    return out


def dropped(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """(rid, rid2, exact, near): places of the lines that go from each document; equal to an earlier line, or only close to one."""
    known = classes(docs, edits, per)
    first = known.groupBy("label").agg(F.min("at").alias("stays"), F.sum("n").alias("all")).where("all > 1")
    status = Staging(docs.sparkSession, "status").keep(known.join(first, "label").select("h", "g", "at", "stays"))
    lines = _maybe(_lines(docs).select("doc_id", "rid", "rid2", "pos", "h", "g"), status, status.count())
    rows = lines.join(status, ["h", "g"]).withColumn("here", _at())
    gone = rows.where("here <> stays").withColumn("near", F.col("here") == F.col("at"))
    return gone.groupBy("rid", "rid2").agg(F.collect_set(F.when(~F.col("near"), F.col("pos"))).alias("exact"), F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("near"))


def _rewritten(docs: DataFrame, edits: int, per: int) -> DataFrame:
    """Documents with their kept text, the number of lines with words, and of those that go."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    d = docs.select(F.struct(*docs.columns).alias("row"), *_rid(F.coalesce("text", F.lit(""))))
    d = d.join(dropped(docs, edits, per), ["rid", "rid2"], "left")
    none = F.expr("cast(array() as array<int>)")
    d = d.select("row", F.coalesce("exact", none).alias("exact"), F.coalesce("near", none).alias("near"))
    lines = F.split(text, "\n")
    kept = F.when(F.size("exact") + F.size("near") == 0, text).otherwise(_without(lines, F.array_sort(F.concat("exact", "near"))))
    return d.select("row", kept.alias("kept"), F.size(F.filter(lines, has_word)).alias("n_lines"), F.size("exact").alias("n_exact"), F.size("near").alias("n_near"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines joined again but for those at the ascending places `gone`: what lies between two of them goes together."""
    packed = F.array(F.struct(lines.alias("l"), F.concat(F.array(F.lit(-1)), gone).alias("g")))
    runs = lambda r: F.transform(r["g"], lambda p, k: F.slice(r["l"], p + 2, F.greatest(F.coalesce(F.get(r["g"], k + 1), F.size(r["l"])) - p - 1, F.lit(0))))
    return F.transform(packed, lambda r: F.array_join(F.flatten(runs(r)), "\n"))[0]


def digest(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_exact and n_near that go, kept_sha256 of the text that stays."""
    d = _rewritten(docs.select("doc_id", "text"), edits, per)
    return d.select("row.doc_id", F.col("n_lines").cast("long"), F.col("n_exact").cast("long"), F.col("n_near").cast("long"), F.sha2("kept", 256).alias("kept_sha256"))


def clean(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """Documents with the text that stays (and its n_chars); those left without a word by it go."""
    names = docs.columns
    d = _rewritten(docs, edits, per).where("n_lines = 0 or n_exact + n_near < n_lines")
    new = {"text": F.when(F.col("n_exact") + F.col("n_near") == 0, F.col("row.text")).otherwise(F.col("kept"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("n_exact") + F.col("n_near") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return d.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])

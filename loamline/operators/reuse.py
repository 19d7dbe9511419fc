"""Reuse across owners: exact and near copies, signatures, bans, fingerprints, parity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from loamline.functions import sequences
from loamline.functions.storage import settled
from loamline.functions.text import lines, sized, split_lines


#: Extensions of files that are compared, binary assets first.
ASSETS = (".ttf", ".otf", ".woff", ".woff2", ".onnx", ".bin", ".pt", ".safetensors")
SOURCES = (".py", ".js", ".mjs", ".ts", ".sh", ".md", ".json", ".html", ".css", ".txt", ".yaml", ".yml", ".typ")


def exact_duplicates(files: DataFrame, owner: str, key: str, text: str, least: int = 200, path: str | None = None, size: Callable[[str], Column] = F.octet_length) -> DataFrame:
    """``hash, owners, files, first``: contents of ``least`` bytes or more that several owners hold.

    ``size`` measures a text; ``F.length`` counts characters. With ``path``, only files of known extensions count, and ``kind`` is ASSET
    or DUP by the extension of the first file.
    """
    own = files.where(size(text) >= least)
    if path is not None:
        ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1))
        own = own.withColumn("_ext", ext).where(F.col("_ext").isin(*ASSETS, *SOURCES))
    kind = [] if path is None else [F.when(F.min_by("_ext", key).isin(*ASSETS), "ASSET").otherwise("DUP").alias("kind")]
    own = own.groupBy(F.md5(text).alias("hash")).agg(F.countDistinct(owner).alias("owners"), F.count("*").alias("files"), F.min(key).alias("first"), *kind)
    return own.where("owners >= 2")


def signature_hits(files: DataFrame, engines: DataFrame, allowed: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """``key, id, line``: registered signatures outside their module and allow list, with the line of the first hit.

    ``engines(id, module, signature)``, ``allowed(id, allowed_owner)``; both are small.
    """
    pairs = files.join(sized(engines), F.expr(f"{owner} <> module and {text} rlike signature"))
    pairs = pairs.join(sized(allowed.withColumnRenamed("id", "_id")), (F.col("id") == F.col("_id")) & (F.col(owner) == F.col("allowed_owner")), "left_anti")
    before = F.expr(f"substring({text}, 1, regexp_instr({text}, signature) - 1)")
    return pairs.select(key, "id", (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).cast("long").alias("line"))


def banned_hits(files: DataFrame, bans: DataFrame, key: str, text: str, allow_marker: str) -> DataFrame:
    """``key, id, line``: first line of each file that a banned pattern matches and that lacks the allow marker."""
    ls = lines(files, [key], text).where(~F.col("text").contains(allow_marker))
    return ls.join(sized(bans), F.expr("text rlike pattern")).groupBy(key, "id").agg(F.min("line").cast("long").alias("line"))


def owner_of(path: Column, root: str = ".agents/skills", shared: str = "scripts") -> Column:
    """The owner of a file: the folder below ``root`` of a file inside one, else the first folder of its path."""
    parts = F.split(path, "/")
    depth = root.count("/") + 1
    inside = path.startswith(root + "/") & (F.size(parts) > depth + 1)
    return F.when(inside, F.get(parts, F.lit(depth))).when(F.get(parts, F.lit(0)) == shared, shared).otherwise(F.get(parts, F.lit(0)))


#: Contents of more lines or more owners are met by key and verified from their tables; rarer lines bring all
#: who have them together at once; others are dealt into blocks of so many contents.
LIGHT_LINES, LIGHT_OWNERS, RARE, BLOCK = 32, 64, 256, 512
MOST_KNOWN = 100_000  # matches of short lists that a task remembers


def _entries(lined: DataFrame, block: list[str], ratio: float) -> DataFrame:
    """``token, f, e``: contents at the lines that a partner in ``ratio`` of all lines must share one of, by a prefix filter from the rarest.

    ``f`` is the number of contents that have the line (the nth repeat of a line
    is a line of its own). ``e`` holds the content, its number of lines, the
    line's place ``i`` among them from the rarest and, of contents with few
    lines and owners, those that others have too from the rarest (``ranked``),
    all in the order of the text (``lines``) and the ``members``.
    """
    if "members" not in lined.columns:
        lined = lined.withColumns({"owners": F.lit(LIGHT_OWNERS + 1), "shared": F.lit(False), "members": F.lit(None).cast("array<struct<k:bigint,o:string>>")})
    rows = lined.repartition("c").select(*block, "c", F.explode("lines").alias("l"))
    nth = F.row_number().over(Window.partitionBy("c", "l").orderBy(F.lit(0)))
    rows = rows.withColumn("token", F.xxhash64(*block, "l", nth)).select("c", "token")
    often = rows.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    ranks = rows.join(often, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("s"))
    n = F.size("lines")
    light = (n <= LIGHT_LINES) & (F.col("owners") <= LIGHT_OWNERS)
    known = lined.select("c", n.alias("n"), (n > F.size(F.array_distinct("lines"))).alias("repeats"), "shared", light.alias("light"), "members", "lines")
    lists = [F.when(F.col("light"), c).alias(name) for name, c in (("ranked", F.transform("s", lambda t: t["token"])), ("lines", F.col("lines")), ("members", F.col("members")))]
    per = settled(known.join(ranks, "c").select("c", "n", "repeats", "shared", "light", *lists, "s"), "ranks")
    # A pair needs ratio / 2 of all lines in common, so of a content at least ratio / (2 - ratio) of its own.
    most = F.size("s") - F.ceil(F.col("n") * (ratio / (2 - ratio)) - 1e-9).cast("int") + 1
    first = per.select("*", F.posexplode(F.slice("s", F.lit(1), F.greatest(most, F.lit(0)))).alias("j", "t"))
    i = F.col("n") - F.size("s") + F.col("j") + 1
    only = F.when(F.size("members") == 1, F.get("members", F.lit(0))["o"]).alias("only")
    return first.select("t.token", "t.f", F.struct("c", "n", i.alias("i"), "repeats", "shared", "light", "ranked", "lines", only, "members").alias("e"))


def _enough(x: Column, y: Column, ratio: float) -> Column:
    """Whether two that first meet at a line may have enough lines in common, given the places of it: at most the rest of the shorter rest."""
    return 2.0 * F.least(x["n"], y["n"], _room(x, y)) / (x["n"] + y["n"]) >= ratio


def _room(x: Column, y: Column) -> Column:
    return 1 + F.least(x["n"] - x["i"], y["n"] - y["i"])


def _hard(x: Column, y: Column) -> Column:
    """Whether a pair may have to be verified line by line: its contents are large, have repeats, or common lines may be in any order."""
    return ~x["light"] | ~y["light"] | x["repeats"] | y["repeats"] | (_room(x, y) > 2)


def _meetings(entries: DataFrame, ratio: float, hard: bool) -> DataFrame:
    """``token, x, y``: pairs of entries that meet at a line and may agree; with ``hard`` only those that ``_hard`` tells of.

    Those who have a rare line are one list. Those who have a frequent one are
    dealt into blocks, alike in numbers and flags, and each pair of blocks that
    may agree is compared by itself: no task holds all who have a line.
    """
    x, y = F.col("x"), F.col("y")
    wanted = lambda x, y: _enough(x, y, ratio) & ~(x["shared"] & y["shared"]) & (_hard(x, y) if hard else x["light"] & y["light"])
    lists = entries["rare"].select("token", "list", F.col("list").alias("other"), F.lit(True).alias("inside"))
    own = entries["blocks"]
    head = own.select("token", "kind", "block", F.size("list").alias("size"), F.get("list", F.lit(0)).alias("e")).select("token", "kind", "block", "size", *(F.col(f"e.{c}") for c in ("n", "i", "shared", "light", "repeats")))
    head = head.select("token", F.struct("kind", "block").alias("at"), "size", F.struct("n", "i", "shared", "light", "repeats").alias("e"))
    one, two = (head.select("token", *(F.col(c).alias(f"{c}{s}") for c in ("at", "size", "e"))) for s in "xy")
    pairs = one.join(two, "token").where("atx < aty or (atx = aty and sizex > 1)").where(wanted(F.col("ex"), F.col("ey"))).select("token", "atx", "aty")
    side = lambda s, name: own.select("token", F.struct("kind", "block").alias(f"at{s}"), F.col("list").alias(name))
    tasks = 8 * own.sparkSession.sparkContext.defaultParallelism
    crossed = pairs.join(side("x", "list"), ["token", "atx"]).join(side("y", "other"), ["token", "aty"]).repartition(tasks, "token", "atx", "aty")
    lists = lists.unionByName(crossed.select("token", "list", "other", F.expr("atx = aty").alias("inside")))
    met = lists.select("token", "inside", "other", F.explode("list").alias("x")).select("token", "inside", "x", F.explode("other").alias("y"))
    return met.where((~F.col("inside") | (x["c"] < y["c"])) & wanted(x, y)).select("token", "x", "y")


def _dealt(entries: DataFrame) -> dict[str, DataFrame]:
    """Entries as lists: ``rare`` with all that meet at a line, ``blocks`` with ``BLOCK`` or so of those alike."""
    rare = entries.where(F.col("f") <= RARE).groupBy("token").agg(F.collect_list("e").alias("list")).where(F.size("list") > 1)
    flags = sum(F.col(f"e.{c}").cast("long") * k for c, k in (("shared", 1), ("light", 2), ("repeats", 4)))
    often = entries.where(F.col("f") > RARE).withColumn("kind", F.col("e.n") * F.lit(1 << 32) + F.col("e.i") * F.lit(8) + flags)
    crowds = often.groupBy("token", "kind").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("e.c"), F.coalesce("blocks", F.lit(1)))
    blocks = often.join(crowds, ["token", "kind"], "left").groupBy("token", "kind", block.alias("block")).agg(F.collect_list("e").alias("list"))
    return {"rare": rare, "blocks": settled(blocks, "blocks")}


def _once(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with values that several later expressions use, computed once for each row (a projection may be merged into them)."""
    return rows.select("*", F.inline(F.array(F.struct(*(v.alias(name) for name, v in values.items())))))


def _agreeing(met: DataFrame, ratio: float, sequence: bool) -> DataFrame:
    """Of light ``x, y`` that meet at their rarest common line those with enough lines in common, and ``matched``, null where it takes their blocks.

    One common line is one match; several without repeats are all matched where
    they stand in the same order, and one is where they stand in reverse.
    """
    x, y = F.col("x"), F.col("y")
    met = _once(met, common=F.array_intersect(x["ranked"], y["ranked"])).where(F.get("common", F.lit(0)) == F.col("token"))
    met = met.where(2.0 * F.size("common") / (x["n"] + y["n"]) >= ratio)
    if not sequence:
        return met.withColumn("matched", F.size("common"))
    simple = (F.size("common") > 1) & ~x["repeats"] & ~y["repeats"]
    both = {name: F.when(simple, F.array_intersect(p["lines"], q["lines"])) for name, p, q in (("there", x, y), ("back", y, x))}
    ordered = F.when(F.col("there") == F.col("back"), F.size("common")).when(F.col("there") == F.reverse("back"), 1)
    return _once(_once(met, **both), matched=F.when(F.size("common") == 1, 1).otherwise(ordered))


def _compared(dealt: dict[str, DataFrame], ratio: float, sequence: bool) -> DataFrame:
    """``a, b, ratio``: pairs of files with light contents, compared where they meet, at the rarest line that they have in common."""
    x, y = F.col("x"), F.col("y")
    other_owners = ~F.coalesce(x["only"] == y["only"], F.lit(False))

    def files(met: DataFrame, *more: Column) -> DataFrame:
        found = met.select(y["members"].alias("others"), F.explode(x["members"]).alias("p"), *more)
        return found.select("*", F.explode("others").alias("q")).where("p.o <> q.o")

    a, b = F.least("p.k", "q.k").alias("a"), F.greatest("p.k", "q.k").alias("b")
    agreed = (2.0 * F.col("matched") / (x["n"] + y["n"])).alias("ratio")
    easy = files(_agreeing(_meetings(dealt, ratio, False).where(other_owners), ratio, sequence).where(agreed >= ratio), agreed).select(a, b, "ratio")
    if not sequence:
        return easy
    hard = _agreeing(_meetings(dealt, ratio, True).where(x["light"] & y["light"] & other_owners), ratio, sequence).where("matched is null")
    hard = files(hard, x["lines"].alias("lx"), y["lines"].alias("ly"))
    side = lambda one, two: F.when(F.col("p.k") < F.col("q.k"), F.col(one)).otherwise(F.col(two))
    hard = hard.select(a, b, side("lx", "ly").alias("la"), side("ly", "lx").alias("lb"))
    return easy.unionByName(hard.mapInArrow(_in_blocks(ratio), easy.schema))


def _candidates(lined: DataFrame, block: list[str], ratio: float, dealt: dict[str, DataFrame] | None = None) -> DataFrame:
    """``x, y``: contents whose bags of lines may agree in ``ratio`` or more, but for those that ``_compared`` compares.

    The first line that two contents share leaves at most the rest of the
    shorter rest in common; where that is too little for ``ratio``, they do not
    meet there. Lines that many short contents end with so bring no pairs.
    """
    met = _meetings(dealt or _dealt(_entries(lined, block, ratio)), ratio, True).where("not x.light or not y.light")
    return met.select(F.least("x.c", "y.c").alias("x"), F.greatest("x.c", "y.c").alias("y")).distinct()


def _slices(lists: pa.ListArray) -> list[np.ndarray]:
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _in_sequence(ratio: float, sequence: bool):
    """Of rows ``x, y, lx, ly`` those that agree in ``ratio`` or more of their lines, with their numbers of lines and of matched ones.

    Lines are matched from either side (``xy``, ``yx``), as blocks may differ by
    that; without ``sequence`` by their bags.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [_slices(batch.column(c)) for c in (2, 3)]
            kept, found = [], []
            for i, (a, b) in enumerate(zip(*sides)):
                both = sequences.agreement(a, b, ratio, sequence)
                if both is not None and 2.0 * max(both) / (len(a) + len(b)) >= ratio:
                    kept.append(i)
                    found.append((len(a), len(b), *both))
            counts = np.array(found, np.int64).reshape(-1, 4)
            ids = batch.select([0, 1]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*ids.columns, *(pa.array(counts[:, c]) for c in range(4))], ["x", "y", "nx", "ny", "xy", "yx"])

    return run


def _in_blocks(ratio: float):
    """``a, b, ratio`` of rows ``a, b, la, lb`` of short lists that agree in ``ratio`` or more of their lines, in matching blocks.

    Which lines are equal decides that. Pairs that have this in common, as most
    of a few lines have, are matched once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int, bytes], int] = {}
        for batch in batches:
            sides = [batch.column(c) for c in (2, 3)]
            starts, sizes = zip(*((o[:-1], np.diff(o)) for o in (s.offsets.to_numpy() for s in sides)))
            values = [s.values.to_numpy(zero_copy_only=False) for s in sides]
            matched = np.zeros(batch.num_rows, np.int64)
            shapes, shape = np.unique(np.stack(sizes, 1), axis=0, return_inverse=True)
            for k, (n, m) in enumerate(shapes.tolist()):
                rows = np.flatnonzero(shape.ravel() == k)
                one, two = (v[s[rows, None] + np.arange(w)] for v, s, w in zip(values, starts, (n, m)))
                alike = np.packbits((one[:, :, None] == two[:, None, :]).reshape(len(rows), n * m), axis=1)
                _, first, kind = np.unique(alike.view(f"V{alike.shape[1]}").ravel(), return_index=True, return_inverse=True)
                found = []
                for at in first:
                    equal = (n, m, alike[at].tobytes())
                    if equal not in known:
                        if len(known) >= MOST_KNOWN:
                            known.clear()
                        known[equal] = sequences.matched(one[at], two[at])
                    found.append(known[equal])
                matched[rows] = np.array(found, np.int64)[kind.ravel()]
            agreed = 2.0 * matched / (sizes[0] + sizes[1])
            kept = pa.array(agreed >= ratio)
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).filter(kept).columns, pa.array(agreed).filter(kept)], ["a", "b", "ratio"])

    return run


def near_duplicates(files: DataFrame, key: str, owner: str, text: str, ratio: float = 0.8, block: list[str] | None = None, sequence: bool = True, least_bytes: int = 200) -> DataFrame:
    """``a, b, ratio``: files of different owners, ``a`` the one of smaller key, that agree in ``ratio`` or more of their lines.

    The ratio is twice the lines in matching blocks over all lines, so their
    order counts; without ``sequence`` it is twice the common lines (with
    repeats), which is never less. Only files alike in the columns ``block`` (a
    file name, say) are compared. Two files whose contents, of ``least_bytes``
    or more, other owners hold as well are exact copies, and left out. Equal
    contents of one owner enter once. Null and empty texts have no lines and no
    partner. The ratio is rounded to 4 digits after the threshold.

    Lines are ordered from the rarest, the nth repeat of a line being a line of
    its own: two contents that agree so far share one of the first lines that
    leave too few others, so only such contents are compared, and none is lost.
    """
    block = block or []
    # Texts are read once and leave no task: hashes of their lines stand for them.
    hashed = F.transform(split_lines(F.col(text)), lambda line: F.xxhash64(line)).alias("lines")
    marked = files.where(F.length(text) > 0).select(*block, F.col(owner).alias("o"), F.col(key).alias("k"), F.md5(text).alias("h"), F.octet_length(text).alias("bytes"), hashed)
    marked = settled(marked, "lines")
    held = marked.groupBy(*block, "o", "h").agg(F.min("k").alias("k"), F.max("bytes").alias("bytes"))
    shared = held.where(F.col("bytes") >= least_bytes).groupBy("h").agg(F.countDistinct("o").alias("_owners")).where("_owners > 1").select("h", F.lit(True).alias("shared"))
    of = Window.partitionBy(*block, "h")
    counted = held.withColumns({"c": F.min("k").over(of), "owners": F.count("*").over(of)})
    few = F.collect_list(F.when(F.col("owners") <= LIGHT_OWNERS, F.struct("k", "o"))).alias("members")
    contents = counted.groupBy(*block, "h").agg(F.min("c").alias("c"), F.max("owners").alias("owners"), few)
    contents = contents.join(shared, "h", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    texts = marked.select(F.struct(*block, "h", F.col("k").alias("c")).alias("at"), "lines").dropDuplicates(["at"]).select("at.*", "lines")
    # Contents without a value in a column of ``block`` are alike to none.
    lined = settled(contents.join(texts, [*block, "h", "c"]).select(*block, "h", "c", "owners", "shared", "members", "lines"), "contents")
    dealt = _dealt(_entries(lined, block, ratio))
    pairs = _candidates(lined, block, ratio, dealt)
    side = lambda s: lined.select(F.col("c").alias(s), F.col("lines").alias("l" + s))
    texts = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "lx", "ly")
    kind = dict(texts.dtypes)["x"]
    pairs = texts.mapInArrow(_in_sequence(ratio, sequence), f"x {kind}, y {kind}, nx long, ny long, xy long, yx long")
    whole = F.size("lines")
    same = lined.where(~F.col("shared") & (F.col("owners") > 1)).select(F.col("c").alias("x"), F.col("c").alias("y"), *(whole.cast("long").alias(c) for c in ("nx", "ny", "xy", "yx")))
    pairs = pairs.select("x", "y", "nx", "ny", "xy", "yx").unionByName(same)
    member = held.join(lined.select(*block, "h", "c", "shared"), [*block, "h"])
    side = lambda s: member.select(F.col("c").alias(s), F.col("k").alias("k" + s), F.col("o").alias("o" + s), F.col("shared").alias("s" + s))
    met = pairs.join(side("x"), "x").join(side("y"), "y").where("ox <> oy and not (sx and sy) and (x <> y or kx < ky)")
    turned = F.col("kx") < F.col("ky")
    agreed = 2.0 * F.when(turned, F.col("xy")).otherwise(F.col("yx")) / (F.col("nx") + F.col("ny"))
    found = met.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), agreed.alias("ratio"))
    return found.where(F.col("ratio") >= ratio).unionByName(_compared(dealt, ratio, sequence)).withColumn("ratio", F.round("ratio", 4))


def oversize_shims(files: DataFrame, key: str, text: str, marker: str, most_lines: int = 30) -> DataFrame:
    """Files with ``marker`` in their first 400 characters that are longer than ``most_lines`` lines."""
    n = F.size(F.split(text, "\n", -1))
    return files.where(F.substring(text, 1, 400).contains(marker) & (n > most_lines)).select(key, n.cast("long").alias("n_lines"))


def undeclared_use(files: DataFrame, declarations: DataFrame, owner: str, text: str, use: str, heading: str) -> DataFrame:
    """Owners that use shared code but whose declaration lacks the heading."""
    users = files.where(F.col(text).rlike(use)).select(owner).distinct()
    return users.join(declarations.where(F.col("declaration").contains(heading)).select(owner), owner, "left_anti")


def findings_report(findings: DataFrame, level: str, code: str) -> DataFrame:
    """``level, code, n, rank``: counts, FAIL before WARN, then by code."""
    n = findings.groupBy(level, code).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.when(F.col(level) == "FAIL", 0).otherwise(1), code)))


def folder_fingerprint(files: DataFrame, owner: str, key: str, text: str) -> DataFrame:
    """``owner, fingerprint``: hash of the hashes of an owner's parts, each the hash of its files' hashes in order of their keys.

    A file's part is the first three digits of its key's MD5, so an owner of any
    number of files has 4096 parts at most.
    """
    part = F.substring(F.md5(F.col(key).cast("string")), 1, 3).alias("part")
    ordered = lambda order, h: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, h))), lambda s: s["h"]), "")
    parts = files.groupBy(owner, part).agg(F.sha2(ordered(key, F.sha2(text, 256).alias("h")), 256).alias("h"))
    return parts.groupBy(owner).agg(F.sha2(ordered("part", F.col("h")), 256).alias("fingerprint"))


def changed_since(current: DataFrame, certified: DataFrame, owner: str) -> DataFrame:
    """Owners whose fingerprint is new or differs from the certified one."""
    old = certified.select(F.col(owner).alias("_o"), F.col("fingerprint").alias("_f"))
    return current.join(old, F.col(owner) == F.col("_o"), "left").where(~F.col("fingerprint").eqNullSafe(F.col("_f"))).select(owner, F.when(F.col("_o").isNull(), "new").otherwise("changed").alias("change"))


def contract_score(docs: DataFrame, checks: DataFrame, key: str, text: str, pass_mark: int = 80) -> DataFrame:
    """``key, score, errors, validated``: points of matched checks; unmatched ones of level error forbid validation.

    ``checks(layer, pattern, points, level)`` is a small table.
    """
    j = docs.crossJoin(sized(checks)).withColumn("_ok", F.expr(f"{text} rlike pattern"))
    per = j.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("_ok"), F.col("points"))), F.lit(0)).alias("score"), F.count_if(~F.col("_ok") & (F.col("level") == "error")).alias("errors"))
    return per.withColumn("validated", (F.col("score") >= pass_mark) & (F.col("errors") == 0))


def registry_gaps(items: DataFrame, registry: DataFrame, name: str, text: str) -> DataFrame:
    """Items that no registry text mentions as they are, with hyphens or with underscores for blanks."""
    n = F.lower(F.col(name))
    mentioned = F.lower(F.col(text)).contains(n) | F.lower(F.col(text)).contains(F.replace(n, F.lit(" "), F.lit("-"))) | F.lower(F.col(text)).contains(F.replace(n, F.lit(" "), F.lit("_")))
    return items.join(sized(registry.select(text)), mentioned, "left_anti")


def parity_check(registry: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``key, problem``: registered without a file, files not registered, registered more than once."""
    r = registry.groupBy(key).agg(F.count("*").alias("_r"))
    f = files.select(key).distinct().withColumn("_f", F.lit(True))
    j = r.join(f, key, "full")
    problem = F.when(F.col("_f").isNull(), "missing").when(F.col("_r").isNull(), "orphan").when(F.col("_r") > 1, "duplicate")
    return j.select(key, problem.alias("problem")).where("problem is not null")


def nested_references(registry: DataFrame, key: str, column: str, fields: list[str]) -> DataFrame:
    """``key, path, target``: every string that a nested ``column`` holds in one of ``fields``, in a list or by itself, at any depth.

    Structs, lists and maps are walked down their type; the path names fields
    and map keys, and has the places of lists from 0.
    """
    none = F.array().cast("array<struct<path:string,target:string>>")

    def walk(value: Column, kind: DataType, path: Column, wanted: bool) -> Column:
        if isinstance(kind, StringType):
            return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.alias("target")))).otherwise(none) if wanted else none
        if isinstance(kind, ArrayType):
            parts = F.transform(value, lambda x, i: walk(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), wanted))
            return F.coalesce(F.flatten(parts), none)
        if isinstance(kind, MapType):
            parts = F.transform(F.map_entries(value), lambda e: walk(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")), wanted))
            return F.coalesce(F.flatten(parts), none)
        if isinstance(kind, StructType):
            parts = [walk(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), f.name in fields) for f in kind.fields if _holds_strings(f.dataType)]
            return F.concat(*parts) if parts else none
        return none

    found = walk(F.col(column), registry.schema[column].dataType, F.lit(column), column in fields)
    return registry.select(key, F.explode(found).alias("_r")).select(key, "_r.path", "_r.target")


def _holds_strings(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_strings(kind.elementType)
    if isinstance(kind, MapType):
        return _holds_strings(kind.valueType)
    return isinstance(kind, StringType) or isinstance(kind, StructType) and any(_holds_strings(f.dataType) for f in kind.fields)


def invalid_references(registry: DataFrame, key: str, column: str, fields: list[str], existing: DataFrame, name: str) -> DataFrame:
    """``key, path, target`` of nested references to what is not in ``existing``."""
    there = existing.select(F.col(name).alias("target")).distinct()
    return nested_references(registry, key, column, fields).join(there, "target", "left_anti").select(key, "path", "target")


def inventory_compare(a: DataFrame, b: DataFrame, key: str, size: str) -> DataFrame:
    """``side (a | b | both), n, size`` of the distinct keys of two inventories."""
    x = a.groupBy(key).agg(F.max(size).alias("_a"))
    y = b.groupBy(key).agg(F.max(size).alias("_b"))
    side = F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b").otherwise("both")
    return x.join(y, key, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.sum(F.coalesce("_a", "_b")).alias("size"))

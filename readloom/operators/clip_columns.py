"""The clips of clip.py as columns, so that no record and no track is handed to Python.

Each function has the name and the result of the one in clip.py that it stands for; where that takes a record, the
columns of the stage before are given. Windows that end before they begin count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom import schema as S
from readloom.functions.cigar import QUERY_OPS, REFERENCE_OPS, query_length, reference_length
from readloom.functions.sequence import reverse_complement


def zero() -> Column:
    return F.lit(0).cast("bigint")


def empty(kind: T.DataType | str = "array<bigint>") -> Column:
    """An empty list or map."""
    return (F.create_map() if isinstance(kind, T.MapType) else F.array()).cast(kind)



def piece(items: Column, offset: Column, length: Column) -> Column:
    """items[offset : offset + length] of an array."""
    return F.slice(items, (offset + 1).cast("int"), F.greatest(length, zero()).cast("int"))


def text_piece(text: Column, offset: Column, length: Column) -> Column:
    """The same of text or bytes."""
    return F.substring(text, (offset + 1).cast("int"), F.greatest(length, zero()).cast("int"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def has(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def int_value(x: Column) -> Column:
    parts = {"t": F.lit("i"), "i": x.cast("bigint")}
    return F.struct(*(parts.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in S.TAG))


# --- CIGAR ---------------------------------------------------------------------------------


def cut_front(cigar: Column, count: Column, counted: str) -> Column:
    """struct: at operations go, rest is left of the next one (0: all of it), query and reference were cut."""

    def step(a: Column, o: Column) -> Column:
        op, n = o["op"], o["len"].cast("bigint")
        taken = F.when(op.isin(*counted), F.least(n, a["left"])).otherwise(n)
        cut = F.struct(
            (a["at"] + F.when(taken < n, 0).otherwise(1)).alias("at"),
            (n - taken).alias("rest"),
            (a["query"] + F.when(op.isin(*QUERY_OPS), taken).otherwise(0)).alias("query"),
            (a["reference"] + F.when(op.isin(*REFERENCE_OPS), taken).otherwise(0)).alias("reference"),
            (a["left"] - F.when(op.isin(*counted), taken).otherwise(0)).alias("left"),
        )
        return F.when(a["left"] > 0, cut).otherwise(a)

    begin = F.struct(*(zero().alias(k) for k in ("at", "rest", "query", "reference")), count.cast("bigint").alias("left"))
    return F.when(count > 0, F.aggregate(cigar, begin, step)).otherwise(begin)


def left_of(cigar: Column, cut: Column) -> Column:
    at, size = cut["at"], F.size(cigar)
    part = F.struct(F.get(cigar, at.cast("int"))["op"].alias("op"), cut["rest"].cast("int").alias("len"))
    return F.when(cut["rest"] > 0, F.concat(F.array(part), piece(cigar, at + 1, size - at - 1))).when(at > 0, piece(cigar, at, size - at)).otherwise(cigar)


# --- base modifications --------------------------------------------------------------------


def parse_modifications(text: Column) -> Column:
    """array of struct (prefix, skips)."""

    def part(p: Column) -> Column:
        prefix = F.regexp_extract(p, r"(?s)^..(?:[0-9]+|[A-Za-z]*)[?.]?", 0)
        # What follows is read up to the first sign that continues no number.
        tail = F.regexp_extract(F.substring(p, F.length(prefix) + 1, F.length(p)), "^[-,0-9]*", 0)
        skips = F.regexp_extract_all(F.regexp_replace(tail, "(?:,,|--|-,).*$", ""), F.lit("-?[0-9]+"), F.lit(0))
        return F.struct(prefix.alias("prefix"), skips.cast("array<bigint>").alias("skips"))

    return F.transform(F.filter(F.split(text, ";"), lambda p: F.length(p) >= 3), part)


def modification_codes(prefix: Column) -> Column:
    code = F.regexp_replace(F.substring(prefix, F.lit(3), F.length(prefix)), r"[?.]$", "")
    return F.when(code.rlike("^[0-9]"), 1).otherwise(F.length(code)).cast("bigint")


def clip_sites(parts: Column, seq: Column, offset: Column, length: Column, reverse: Column) -> Column:
    """parts with first and last: their sites in the window, kept: the skips of those, and each: values of a site."""
    end = F.length(seq) - offset - length
    before = F.when(reverse, text_piece(seq, offset + length, end)).otherwise(text_piece(seq, zero(), offset))

    def count(base: Column, text: Column) -> Column:
        return (F.length(text) - F.when(base == "N", 0).otherwise(F.length(F.replace(text, base, F.lit(""))))).cast("bigint")

    def counted(p: Column) -> Column:
        base = F.substring(p["prefix"], 1, 1)
        base = F.when(reverse & (base != "N"), reverse_complement(base)).otherwise(base)
        return p.withField("skipped", count(base, before)).withField("inside", count(base, text_piece(seq, offset, length)))

    def scan(p: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            ordinal = a["ordinal"] + x + 1
            return F.struct(
                ordinal.alias("ordinal"),
                (a["first"] + (ordinal <= p["skipped"]).cast("bigint")).alias("first"),
                (a["last"] + (ordinal <= p["skipped"] + p["inside"]).cast("bigint")).alias("last"),
                F.when(ordinal <= p["skipped"], ordinal).otherwise(a["below"]).alias("below"),
            )

        return p.withField("scan", F.aggregate(p["skips"], F.struct(*(zero().alias(k) for k in ("ordinal", "first", "last", "below"))), step))

    def cut(p: Column) -> Column:
        first, last = p["scan"]["first"], p["scan"]["last"]
        head = p["scan"]["below"] + F.get(p["skips"], first.cast("int")) - p["skipped"]
        kept = F.when(last > first, F.concat(F.array(head), piece(p["skips"], first + 1, last - first - 1))).otherwise(empty())
        return F.struct(p["prefix"].alias("prefix"), p["skips"].alias("skips"), first.alias("first"), last.alias("last"), kept.alias("kept"), modification_codes(p["prefix"]).alias("each"))

    return F.transform(F.transform(F.transform(parts, counted), scan), cut)


# --- tag strategies ------------------------------------------------------------------------


class Window:
    """The window of the sequence and the record before the clip, as columns."""

    def __init__(self, offset: Column, length: Column, seq: Column, reverse: Column, modifications: Column, called: Column, first: Column, last: Column):
        self.offset, self.length, self.seq, self.reverse = offset, length, seq, reverse
        self.modifications, self.called, self.first, self.last = modifications, called, first, last


def _window(value: Column, offset: Column, length: Column) -> Column:
    out = F.when(~value["t"].isin("Z", "H", "B"), None)
    for name, size, cut in (("s", F.length, text_piece), ("ai", F.size, piece), ("af", F.size, piece)):
        track = value[name]
        out = out.when(track.isNotNull(), F.when(offset + length > size(track), value).otherwise(value.withField(name, cut(track, offset, length))))
    return out


def clip_track(value: Column, w: Window) -> Column:
    return _window(value, w.offset, w.length)


def clip_mirrored_track(value: Column, w: Window) -> Column:
    return F.when(w.offset + w.length <= F.length(w.seq), _window(value, F.length(w.seq) - w.offset - w.length, w.length))


def clip_pulses(value: Column, w: Window) -> Column:
    """called: the pulses with A for each called base; first, last: the places of the window's."""
    return F.when(w.length == 0, _window(value, zero(), zero())).when(w.last < F.length(w.called), _window(value, w.first, w.last - w.first + 1))


def clip_modifications(value: Column, w: Window) -> Column:
    def sites(text: Column) -> Column:
        return clip_sites(parse_modifications(text), w.seq, w.offset, w.length, w.reverse)

    def part(p: Column) -> Column:
        return F.concat(F.array_join(F.concat(F.array(p["prefix"]), p["kept"].cast("array<string>")), ","), F.lit(";"))

    def step(a: Column, p: Column) -> Column:
        inside = piece(value["ai"], a["at"] + p["first"] * p["each"], (p["last"] - p["first"]) * p["each"])
        return F.struct((a["at"] + F.size(p["skips"]) * p["each"]).alias("at"), F.concat(a["kept"], inside).alias("kept"))

    text = value.withField("s", F.array_join(F.transform(sites(value["s"]), part), ""))
    kept = F.aggregate(sites(w.modifications), F.struct(zero().alias("at"), empty().alias("kept")), step)
    numbers = bound(kept, lambda a: F.when(F.size(value["ai"]) >= a["at"], value.withField("ai", a["kept"])))
    return F.when(w.seq == "", None).when(value["t"] == "Z", text).when((value["t"] == "B") & (w.modifications != "") & value["ai"].isNotNull(), numbers)


def clip_runs(value: Column, w: Window) -> Column:
    flat, end = value["ai"], w.offset + w.length
    names = ("at", "first", "head", "last", "tail")

    def step(a: Column, i: Column) -> Column:
        run = F.get(flat, i * 2)
        inside = F.least(a["at"] + run, end) - F.greatest(a["at"], w.offset)
        there = inside > 0
        parts = (
            a["at"] + run,
            F.when(there & a["first"].isNull(), i.cast("bigint")).otherwise(a["first"]),
            F.when(there & a["first"].isNull(), inside).otherwise(a["head"]),
            F.when(there, i.cast("bigint")).otherwise(a["last"]),
            F.when(there, inside).otherwise(a["tail"]),
        )
        return F.struct(*(x.alias(k) for k, x in zip(names, parts, strict=True)))

    def finish(a: Column) -> Column:
        def kept(i: Column) -> Column:
            inside = F.when(i == a["first"], a["head"]).when(i == a["last"], a["tail"]).otherwise(F.get(flat, (i * 2).cast("int")))
            return F.when(inside > 0, F.array(inside, F.get(flat, (i * 2 + 1).cast("int")))).otherwise(empty())

        whole = (a["at"] == F.length(w.seq)) & (end <= F.length(w.seq)) & a["first"].isNotNull()
        return F.when(whole, value.withField("ai", F.flatten(F.transform(F.sequence(a["first"], a["last"]), kept))).withField("et", F.lit("C")))

    begin = F.struct(*((zero() if k == "at" else F.lit(None).cast("bigint")).alias(k) for k in names))
    half = (F.size(flat) / 2).cast("int")
    cut = bound(F.aggregate(F.sequence(F.lit(0), half - 1), begin, step), finish)
    return (
        F.when((value["t"] != "B") | ~F.coalesce(value["et"].isin("C", "c"), F.lit(False)), None)
        .when(w.length == 0, value.withField("ai", empty()))
        .when((F.size(flat) >= 2) & (F.size(flat) % 2 == 0), cut)
    )


STRATEGIES: dict[str, Callable[[Column, Window], Column]] = {f.__name__: f for f in (clip_track, clip_mirrored_track, clip_pulses, clip_modifications, clip_runs)}


# --- DataFrames ----------------------------------------------------------------------------


def clip(reads: DataFrame, kind: str, start: Column, end: Column, excise: bool, keys: dict[str, list[str]], only: list[str] | None = None) -> DataFrame:
    """Each read clipped to its window; keys: the tags that each strategy, given by its name, is for; only: see clip.clip."""
    # A generated method beyond this size is never compiled by the JVM; Spark then runs it operator by operator.
    reads.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    columns, tags = reads.columns, F.coalesce(F.col("tags"), empty(S.READS["tags"].dataType))

    def number(key: str, default: Column) -> Column:
        value = F.col("tags")[key]
        wrong = F.raise_error(F.lit(f"tag {key} is no number")).cast("bigint")
        return F.when(value.isNull(), default).when(value["t"] == "A", F.ascii(value["s"])).when(value["t"] == "i", value["i"]).otherwise(wrong).cast("bigint")

    go = start.isNotNull() & end.isNotNull()
    if kind == "reference":
        go = go & (F.col("flag").bitwiseAND(S.UNMAPPED) == 0)
    seq = F.coalesce(F.col("seq"), F.lit(""))
    rows = reads.withColumns(
        {
            "_go": F.coalesce(go, F.lit(False)),
            "_start": start.cast("bigint"),
            "_end": end.cast("bigint"),
            "_reverse": F.coalesce(F.col("flag").bitwiseAND(S.REVERSE) != 0, F.lit(False)),
            "_cigar": F.coalesce(F.col("cigar"), empty(S.CIGAR)),
            "_seq": seq,
        }
    ).withColumns({"_qs": F.when(F.col("_go"), number("qs", zero())), "_qe": F.when(F.col("_go"), number("qe", F.length("_seq").cast("bigint")))})
    c = {name: F.col("_" + name) for name in ("go", "start", "end", "reverse", "cigar", "seq", "qs", "qe", "front", "back", "cut", "left", "cut2", "gone", "gone2", "offset", "length", "called", "first", "last")}
    counted = QUERY_OPS if kind == "query" else REFERENCE_OPS
    if kind == "query":
        sides = F.greatest(zero(), c["start"] - c["qs"]), F.greatest(zero(), c["qe"] - c["end"])
        rows = rows.withColumns({n: F.when(c["reverse"], sides[1 - i]).otherwise(sides[i]) for i, n in enumerate(("_front", "_back"))})
    else:
        span = F.col("pos") + reference_length(c["cigar"])
        rows = rows.withColumns({"_front": F.greatest(zero(), c["start"] - F.col("pos")), "_back": F.greatest(zero(), span - c["end"])})
    rows = rows.withColumn("_cut", cut_front(c["cigar"], c["front"], counted)).withColumn("_left", F.reverse(left_of(c["cigar"], c["cut"])))
    rows = rows.withColumn("_cut2", cut_front(c["left"], c["back"], counted)).withColumn("_left2", F.reverse(left_of(c["left"], c["cut2"])))
    if kind == "query":
        rows = rows.withColumns({"_offset": c["front"], "_length": c["end"] - c["start"]})
        pos = F.col("pos") + c["cut"]["reference"]
    else:
        rows = rows.withColumns({"_gone": c["cut"]["query"], "_gone2": c["cut2"]["query"]})
        if excise:
            for gone, side in (("_gone", 0), ("_gone2", -1)):
                left = F.col("_left2")
                at = F.lit(0) if side == 0 else F.size(left) - 1
                op = F.get(left, at)
                inserted = F.coalesce(op["op"] == "I", F.lit(False))
                rest = piece(left, F.lit(1) if side == 0 else zero(), F.size(left) - 1)
                rows = rows.withColumns({gone: F.col(gone) + F.when(inserted, op["len"]).otherwise(0), "_left2": F.when(inserted, rest).otherwise(left)})
        length = F.greatest(zero(), query_length(c["cigar"]) - c["gone"] - c["gone2"])
        rows = rows.withColumns({"_offset": F.when(c["reverse"], c["gone2"]).otherwise(c["gone"]), "_length": length})
        pos = F.greatest(F.col("pos").cast("bigint"), c["start"])

    offset, length = c["offset"], F.greatest(c["length"], zero())
    pulses = F.coalesce(F.col("tags")["pc"]["s"], F.lit(""))
    ascii_only = F.octet_length(pulses) == F.length(pulses)
    kept = F.lit(None).cast("string")
    called = F.when(ascii_only, F.mask(pulses, F.lit("A"), kept, kept, kept)).otherwise(F.regexp_replace(pulses, "[A-Z]", "A"))
    rows = rows.withColumn("_called", called)

    def place(count: Column) -> Column:
        """Of the called base of that number; the length of all if there are fewer."""
        return F.length(F.call_function("substring_index", c["called"], F.lit("A"), count.cast("int"))).cast("bigint")

    rows = rows.withColumns({"_first": place(offset + 1), "_last": place(offset + length)})
    w = Window(offset, length, c["seq"], c["reverse"], F.coalesce(F.col("tags")["MM"]["s"], F.lit("")), c["called"], c["first"], c["last"])
    first = c["start"] if kind == "query" else c["qs"] + offset
    last = c["end"] if kind == "query" else c["qs"] + offset + c["length"]
    bounded = F.col("tags")["qs"].isNotNull()

    def change(key: Column, value: Column) -> Column:
        out = F.when(value.isNull(), value)
        for name, of in keys.items():
            out = out.when(key.isin(*of), STRATEGIES[name](value, w))
        return out.when(key == "MN", int_value(c["length"])).when(bounded & (key == "qs"), int_value(first)).when(bounded & (key == "qe"), int_value(last)).otherwise(value)

    done = {
        "cigar": F.col("_left2"),
        "pos": pos.cast("int"),
        "seq": text_piece(c["seq"], offset, c["length"]),
        "qual": F.when(F.length("qual") > 0, text_piece(F.col("qual"), offset, c["length"])).otherwise(F.col("qual")),
        "tags": F.col("_tags"),
    }
    if only is not None:
        rows = rows.withColumns({f"_tag_{i}": F.col("tags")[key] for i, key in enumerate(only)})
        values = []
        for i, key in enumerate(only):
            value = F.col(f"_tag_{i}")
            if key == "qe":
                new = F.when(bounded, int_value(last)).otherwise(value)
            elif key == "qs":
                new = F.when(bounded, int_value(first))
            elif key == "MN":
                new = F.when(value.isNotNull(), int_value(c["length"]))
            else:
                new = next((STRATEGIES[name](value, w) for name, of in keys.items() if key in of), value)
            values.append(F.when(c["go"] & (value.isNotNull() | F.lit(key == "qe")), new).when(~c["go"], value).alias(key))
        fields = {**done, "tags": F.struct(*values)}
        return rows.select(*((F.when(c["go"], x).otherwise(F.col(n)) if n != "tags" else x).alias(n) if (x := fields.get(n)) is not None else F.col(f"`{n}`") for n in columns))
    rows = rows.withColumn("_tags", F.map_filter(F.transform_values(tags, change), lambda k, v: v.isNotNull()))
    rows = rows.withColumn("_tags", F.when(bounded & F.col("tags")["qe"].isNull(), F.map_concat("_tags", F.create_map(F.lit("qe"), int_value(last)))).otherwise(F.col("_tags")))
    return rows.select(*(F.when(c["go"], done[n]).otherwise(F.col(n)).alias(n) if n in done else F.col(f"`{n}`") for n in columns))

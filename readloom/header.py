"""SAM headers: parsing, formatting, the BAM header block, unions and edits. All on the driver."""

from __future__ import annotations

import copy
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from readloom import schema as S

PROGRAM, VERSION = "readloom", "0.1.0"


@dataclass
class Entry:
    """A header line of a kind: its key (SN or ID) and the other tags in order."""

    key: str
    tags: dict[str, str] = field(default_factory=dict)
    length: int = 0  # of an @SQ

    @property
    def ds(self) -> list[tuple[str, str]]:
        """The DS tag as key=value pairs, in order and with repetitions; parts are trimmed."""
        out = []
        for part in self.tags.get("DS", "").split(";"):
            name, equals, value = part.partition("=")
            if equals:
                out.append((name.strip(), value.strip()))
        return out

    def set_ds(self, pairs: list[tuple[str, str]]) -> None:
        self.tags["DS"] = ";".join(f"{k}={v}" for k, v in pairs)


@dataclass
class Header:
    hd: dict[str, str] = field(default_factory=dict)
    references: list[Entry] = field(default_factory=list)
    read_groups: list[Entry] = field(default_factory=list)
    programs: list[Entry] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)

    @property
    def sort_order(self) -> str:
        return self.hd.get("SO", "")

    def copy(self) -> Header:
        return copy.deepcopy(self)

    def reference_id(self, name: str) -> int:
        """Position of a reference; -1 for an unknown name or '*'."""
        return next((i for i, r in enumerate(self.references) if r.key == name), -1)

    def reference_name(self, ref_id: int) -> str:
        return self.references[ref_id].key if 0 <= ref_id < len(self.references) else "*"

    def to_text(self) -> str:
        lines = []
        if self.hd:
            first = [k for k in ("VN", "SO", "GO", "SS") if k in self.hd]
            lines.append("\t".join(["@HD", *(f"{k}:{self.hd[k]}" for k in [*first, *(k for k in self.hd if k not in first)])]))
        for r in self.references:
            lines.append("\t".join(["@SQ", f"SN:{r.key}", f"LN:{r.length}", *(f"{k}:{v}" for k, v in r.tags.items())]))
        for kind, entries in (("@RG", self.read_groups), ("@PG", self.programs)):
            lines += ["\t".join([kind, f"ID:{e.key}", *(f"{k}:{v}" for k, v in e.tags.items())]) for e in entries]
        lines += [f"@CO\t{c}" for c in self.comments]
        return "".join(line + "\n" for line in lines)

    def to_bam(self) -> bytes:
        """The BAM header block."""
        text = self.to_text().encode()
        out = [b"BAM\1", struct.pack("<I", len(text)), text, struct.pack("<I", len(self.references))]
        for r in self.references:
            name = r.key.encode() + b"\0"
            out += [struct.pack("<I", len(name)), name, struct.pack("<I", r.length)]
        return b"".join(out)


def parse_header(text: str) -> Header:
    """Header lines; an unknown kind of line is skipped, a malformed or repeated one raises ValueError."""
    out, seen_hd = Header(), False
    names: dict[str, int] = {}
    groups: set[str] = set()
    for line in text.splitlines():
        kind, tab, rest = line.partition("\t")
        if kind == "@CO":
            if not tab:
                raise ValueError("missing tab in @CO line")
            out.comments.append(rest)
            continue
        if kind not in ("@HD", "@SQ", "@RG", "@PG"):
            continue
        pairs = [(f[:2], f[3:]) for f in rest.split("\t") if len(f) >= 3 and f[2] == ":"]
        tags = dict(pairs)
        if kind == "@HD":
            if seen_hd:
                raise ValueError("more than one @HD line")
            seen_hd, out.hd = True, tags
        elif kind == "@SQ":
            lengths = {v for k, v in pairs if k == "LN"}
            if "SN" not in tags:
                raise ValueError("missing SN in @SQ line")
            if len(lengths) > 1:
                raise ValueError("conflicting LN in @SQ line")
            length = lengths.pop() if lengths else ""
            if not length.isdecimal() or not 1 <= int(length) <= S.INT_MAX:
                raise ValueError(f"invalid LN in @SQ line of {tags['SN']}")
            if tags["SN"] in names:
                raise ValueError(f"duplicate @SQ SN {tags['SN']}")
            names[tags["SN"]] = len(names)
            out.references.append(Entry(tags.pop("SN"), {k: v for k, v in tags.items() if k != "LN"}, int(length)))
        else:
            if not tags.get("ID"):
                raise ValueError(f"missing ID in {kind} line")
            key = tags.pop("ID")
            if kind == "@RG":
                if key in groups:
                    raise ValueError(f"duplicate @RG ID {key}")
                groups.add(key)
                out.read_groups.append(Entry(key, tags))
            else:  # repeated programs are kept
                out.programs.append(Entry(key, tags))
    return out


def parse_bam_header(data: bytes) -> tuple[Header, int]:
    """Header of BAM data and the length of its header block; the binary references count.

    Raises ValueError for other data and IndexError when data ends within the block.
    """
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    try:
        (n_text,) = struct.unpack_from("<I", data, 4)
        text = data[8 : 8 + n_text]
        (n_ref,) = struct.unpack_from("<I", data, 8 + n_text)
        at, references = 12 + n_text, []
        for _ in range(n_ref):
            (n_name,) = struct.unpack_from("<I", data, at)
            name = data[at + 4 : at + 3 + n_name].decode()
            (length,) = struct.unpack_from("<I", data, at + 4 + n_name)
            references.append(Entry(name, {}, length))
            at += 8 + n_name
    except struct.error as e:
        raise IndexError("truncated BAM header") from e
    header = parse_header(text.split(b"\0")[0].decode())
    if len(header.references) == len(references):
        for own, other in zip(references, header.references, strict=True):
            own.tags = other.tags
    header.references = references
    return header, at


def references_frame(spark: SparkSession, header: Header) -> DataFrame:
    return spark.createDataFrame([(i, r.key, r.length, r.tags) for i, r in enumerate(header.references)], S.REFS)


def read_groups_frame(spark: SparkSession, header: Header) -> DataFrame:
    return spark.createDataFrame([(i, g.key, g.tags) for i, g in enumerate(header.read_groups)], S.READ_GROUPS)


# --- unions --------------------------------------------------------------------------------


def same_references(a: Header, b: Header) -> bool:
    return [(r.key, r.length) for r in a.references] == [(r.key, r.length) for r in b.references]


def merge_union(headers: list[Header]) -> Header:
    """Union for merge and concat: the references must agree; of equal ids the first counts, comments once."""
    out = headers[0].copy()
    for i, other in enumerate(headers[1:], 1):
        if not same_references(out, other):
            raise ValueError(f"input {i} has other references than the first")
        for own, more in ((out.read_groups, other.read_groups), (out.programs, other.programs)):
            have = {e.key for e in own}
            own += [copy.deepcopy(e) for e in more if e.key not in have]
        out.comments += [c for c in other.comments if c not in out.comments]
    return out


def collection_union(headers: list[Header]) -> Header:
    """Union for reading several files as one: as merge_union, but conflicting tags and @HD fields raise."""
    if not headers:
        raise ValueError("at least one file is required")
    out = headers[0].copy()

    def join(own: Entry, other: Entry, what: str) -> None:
        for k, v in other.tags.items():
            if own.tags.setdefault(k, v) != v:
                raise ValueError(f"conflicting tag {k} of {what} {own.key}")

    for other in headers[1:]:
        for k, v in other.hd.items():
            if out.hd.get(k) and v and out.hd[k] != v:
                raise ValueError(f"conflicting @HD {k}")
            out.hd.setdefault(k, v)
        if not same_references(out, other):
            raise ValueError("conflicting references")
        for own, more in zip(out.references, other.references, strict=True):
            join(own, more, "reference")
        for mine, theirs, what in ((out.read_groups, other.read_groups, "read group"), (out.programs, other.programs, "program")):
            by_key = {e.key: e for e in mine}
            for e in theirs:
                if e.key in by_key:
                    join(by_key[e.key], e, what)
                else:
                    mine.append(copy.deepcopy(e))
        out.comments += [c for c in other.comments if c not in out.comments]
    return out


# --- edits ---------------------------------------------------------------------------------


def unique_program_id(header: Header, name: str) -> str:
    """name, or name.N with the least N >= 1 that is free."""
    taken = {p.key for p in header.programs}
    if name not in taken:
        return name
    n = 1
    while f"{name}.{n}" in taken:
        n += 1
    return f"{name}.{n}"


def add_program(header: Header, name: str, command_line: str | None = None) -> None:
    """Appends a @PG that follows the last one."""
    tags = {"PN": PROGRAM, "VN": VERSION}
    if command_line is not None:
        tags["CL"] = command_line
    if header.programs:
        tags["PP"] = header.programs[-1].key
    header.programs.append(Entry(unique_program_id(header, name), tags))


def sorted_header(header: Header, order: str, minimise: bool = False) -> Header:
    """A copy with the @HD fields of a sort order: coordinate, queryname or tag (unknown)."""
    out = header.copy()
    out.hd.setdefault("VN", "1.6")
    out.hd["SO"] = order if order in ("coordinate", "queryname") else "unknown"
    out.hd.pop("GO", None)
    out.hd.pop("SS", None)
    if minimise:
        out.hd["SS"] = f"{'coordinate' if order == 'coordinate' else 'unsorted'}:minhash"
    return out


def undone_header(header: Header, command_line: str | None = None) -> Header:
    """A copy without demultiplexing: read groups at their base id, lima's programs dropped, PP chains closed."""
    out, groups = header.copy(), []
    for g in out.read_groups:
        base = g.key.partition("/")[0]
        if any(x.key == base for x in groups):
            continue
        kept = Entry(base, {k: v for k, v in g.tags.items() if k not in ("BC", "DS")})
        pairs = [(k, v) for k, v in g.ds if not k.startswith("Barcode")]
        if pairs:
            kept.set_ds(pairs)
        groups.append(kept)
    out.read_groups = groups
    dropped = {p.key: p.tags.get("PP") for p in out.programs if p.key.startswith("lima")}
    out.programs = [p for p in out.programs if not p.key.startswith("lima")]
    for p in out.programs:
        parent, met = p.tags.get("PP"), set()
        while parent in dropped and parent not in met:
            met.add(parent)
            parent = dropped[parent]
        if parent is None or parent in dropped:
            p.tags.pop("PP", None)
        else:
            p.tags["PP"] = parent
    add_program(out, f"{PROGRAM}.undo", command_line)
    return out

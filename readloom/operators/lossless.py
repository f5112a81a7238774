"""Lossless clipping: what a query clip removes is kept in tag ls, a msgpack map, and can be restored.

Each map holds the removed flanks (lead, trail) of sequence, qualities, per-base tracks, base
modifications and coverage runs, the corrections at the borders (pMM, psa, ssa), the barcode call
(bc, bq), and in nested the map of the clip before.
"""

from __future__ import annotations

import itertools
import struct
from bisect import bisect_right

from pyspark.sql import DataFrame

from readloom import schema as S
from readloom.operators.clip import clip_record, clip_sites, format_modifications, int_value, map_records, modification_codes, parse_modifications

# Tracks that are kept (True: they run against the sequence), tracks that can't be,
# the tags that demultiplexing adds, and its bits in cx.
TRACKS = {"pw": False, "ip": False, "fp": False, "fi": False, "rp": True, "ri": True, "sm": False, "sx": False}
UNSUPPORTED = frozenset("dq iq mq sq dt st pc pt pq pv pg pa pm ps pi pd px pe sf".split())
DEMULTIPLEXING = ("bc", "bq", "bx", "bl", "bt", "ql", "qt", "ls")
BARCODE_BEFORE, BARCODE_AFTER = 4, 8


# --- msgpack -------------------------------------------------------------------------------


def pack(x) -> bytes:
    """msgpack of None, bool, int, str, bytes, lists, and maps with text keys (in key order), in the shortest forms."""
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if -32 <= x < 128:
            return struct.pack("b", x) if x < 0 else bytes([x])
        forms = ((0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")) if x >= 0 else ((0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q"))
        for code, form in forms:
            try:
                return bytes([code]) + struct.pack(form, x)
            except struct.error:
                continue
        raise OverflowError(x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        data = x.encode()
        return _head(len(data), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + data
    if isinstance(x, bytes):
        return _head(len(x), None, 0, (0xC4, 0xC5, 0xC6)) + x
    if isinstance(x, dict):
        return _head(len(x), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(pack(k) + pack(x[k]) for k in sorted(x))
    return _head(len(x), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(pack, x))


def _head(n: int, short: int | None, limit: int, codes: tuple) -> bytes:
    if short is not None and n < limit:
        return bytes([short | n])
    for code, form, most in zip(codes, (">B", ">H", ">I"), (2**8, 2**16, 2**32), strict=True):
        if code is not None and n < most:
            return bytes([code]) + struct.pack(form, n)
    raise OverflowError(n)


_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZES = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I")}
_SIZES |= {0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}


def unpack(data: bytes):
    value, end = _unpack(data, 0)
    if end != len(data):
        raise ValueError("msgpack data goes on behind its value")
    return value


def _unpack(data: bytes, at: int):
    code = data[at]
    at += 1
    if code < 0x80:
        return code, at
    if code >= 0xE0:
        return code - 256, at
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    if code in _NUMBERS:
        form = _NUMBERS[code]
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    if code in _SIZES:
        kind, form = _SIZES[code]
        n, at = struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    elif code < 0x90:
        kind, n = "map", code & 15
    elif code < 0xA0:
        kind, n = "list", code & 15
    elif code < 0xC0:
        kind, n = "str", code & 31
    else:
        raise ValueError(f"msgpack type {code:#x} isn't used here")
    if kind in ("str", "bin"):
        if at + n > len(data):
            raise ValueError("truncated msgpack data")
        piece = bytes(data[at : at + n])
        return piece.decode() if kind == "str" else piece, at + n
    items = []
    for _ in range(n * (2 if kind == "map" else 1)):
        item, at = _unpack(data, at)
        items.append(item)
    return (dict(zip(items[::2], items[1::2], strict=True)) if kind == "map" else items), at


# --- clipping ------------------------------------------------------------------------------


def _numbers(tags: dict, key: str) -> list[int] | None:
    value = tags.get(key)
    return value["ai"] if value is not None and value["t"] == "B" and value["ai"] is not None else None


def _split_runs(flat: list[int], length: int, left: int, right: int) -> tuple[list[int], list[int], list[int], int, int]:
    """Runs before, in and behind the window; runs across a border stay in it, and lose what lies outside."""
    ends = list(itertools.accumulate(flat[::2]))
    if len(flat) % 2 or (ends[-1] if ends else 0) != length:
        raise ValueError("the runs of tag sa do not cover the sequence")
    first = bisect_right(ends, left)
    last = next(i for i, e in enumerate(ends) if e >= right) + 1
    front, back = left - (ends[first - 1] if first else 0), ends[last - 1] - right
    kept = flat[2 * first : 2 * last]
    kept[0] -= front
    kept[-2] -= back
    return flat[: 2 * first], kept, flat[2 * last :], front, back


def clip_lossless(row: dict, left: int, right: int) -> dict:
    """The row clipped to [left, right) of its sequence; windows that remove nothing or everything leave it.

    Base modifications of a reverse record count from its end and are refused.
    """
    seq, tags = row["seq"] or "", row["tags"] or {}
    n = len(seq)
    if not 0 <= left < right <= n or (left, right) == (0, n):
        return row
    if bad := UNSUPPORTED & tags.keys():
        raise ValueError(f"records with tag {min(bad)} cannot be clipped without loss")
    reverse = bool(row["flag"] & S.REVERSE)
    if reverse and "MM" in tags:
        raise ValueError("reverse records with tag MM cannot be clipped without loss")
    text = None if not row["qual"] else "".join(chr(q + 33) for q in row["qual"])
    flanks = {"lead": {}, "trail": {}}
    sides = [(flanks["lead"], slice(0, left))] * (left > 0) + [(flanks["trail"], slice(right, n))] * (right < n)
    for flank, part in sides:
        flank["sq"] = seq[part]
        if text:
            flank["ql"] = text[part]
        for key, against in TRACKS.items():
            track = _numbers(tags, key)
            if track is not None and len(track) == n:
                flank[key] = track[n - part.stop : n - part.start] if against else track[part]
    root = flanks | {"psa": 0, "ssa": 0, "csa": -1, "nested": None}
    if "MM" in tags and tags["MM"]["t"] == "Z":
        values = _numbers(tags, "ML") or []
        parts = parse_modifications(tags["MM"]["s"])
        if values and len(values) < sum(len(s) * modification_codes(p) for p, s in parts):
            raise ValueError("tag ML is shorter than the sites of tag MM")
        lost, at = {}, 0
        for prefix, skips in parts:
            first, inside = clip_sites(prefix, skips, seq, left, right - left, False)
            last, each = first + len(inside), modification_codes(prefix)
            ordinals = list(itertools.accumulate(s + 1 for s in skips))
            before = left if prefix[0] == "N" else seq[:left].count(prefix[0])
            for flank, sites in ((flanks["lead"], slice(0, first)), (flanks["trail"], slice(last, len(skips)))):
                flank.setdefault("MM", {})[prefix] = skips[sites]
                if values:
                    flank.setdefault("ML", {})[prefix] = values[at + sites.start * each : at + sites.stop * each]
            lost[prefix] = before - (ordinals[first - 1] if first else 0) if inside else 0
            at += len(skips) * each
        if lost:
            root["pMM"] = lost
    runs = _numbers(tags, "sa")
    if runs is not None:
        lead, runs, trail, root["psa"], root["ssa"] = _split_runs(runs, n, left, right)
        if left:
            flanks["lead"]["sa"] = lead
        if right < n:
            flanks["trail"]["sa"] = trail
    call = _numbers(tags, "bc")
    if call is not None and len(call) == 2:
        root["bc"] = f"{call[0]}--{call[1]}"
    if "bq" in tags and tags["bq"]["t"] == "i":
        root["bq"] = tags["bq"]["i"]
    earlier = _numbers(tags, "ls")
    if earlier is not None:
        root["nested"] = unpack(bytes(earlier))
    packed = {**int_value(0), "t": "B", "i": None, "et": "C", "ai": list(pack(root))}
    window = (n - right, n - left) if reverse else (left, right)  # a query window is mirrored on the reverse strand
    out = clip_record(row | {"tags": {k: v for k, v in tags.items() if k != "sa"}}, "query", *window)
    out["tags"] = out["tags"] | {"ls": packed}
    if runs is not None:
        out["tags"]["sa"] = {**tags["sa"], "ai": runs}
    return out


# --- restoring -----------------------------------------------------------------------------


def restore(row: dict) -> dict:
    """The row as before all its lossless clips and its demultiplexing; without tag ls only RG loses its suffix."""
    tags = dict(row["tags"] or {})
    packed = _numbers(tags, "ls")
    if packed is None:
        return row | {"tags": _base_group(tags)}
    seq, quals = row["seq"] or "", list(row["qual"]) if row["qual"] else None
    tracks = {k: list(v) for k in TRACKS if (v := _numbers(tags, k)) is not None}
    runs = _numbers(tags, "sa")
    sites: dict[str, list[int]] = {}
    values: dict[str, list[int]] = {}
    modified = "MM" in tags and tags["MM"]["t"] == "Z"
    if modified:
        flat, at = _numbers(tags, "ML") or [], 0
        for prefix, skips in parse_modifications(tags["MM"]["s"]):
            n = len(skips) * modification_codes(prefix)
            sites[prefix] = skips
            if at + n <= len(flat):
                values[prefix] = flat[at : at + n]
            at += n
    node = unpack(bytes(packed))
    while node is not None:
        if runs is not None:
            if not runs and node.get("csa", -1) != -1:
                runs = [0, node["csa"]]
            if runs:
                runs = [*runs]
                runs[0] += node.get("psa", 0)
                runs[-2] += node.get("ssa", 0)
        if "lead" in node:
            for prefix, lost in node.get("pMM", {}).items():
                if lost > 0 and sites.get(prefix):
                    sites[prefix] = [sites[prefix][0] + lost, *sites[prefix][1:]]
        for side in ("lead", "trail"):
            flank = node.get(side) or {}

            def joined(piece, rest, front):
                return piece + rest if front else rest + piece

            lead = side == "lead"
            seq = joined(flank.get("sq", ""), seq, lead)
            if quals is not None and "ql" in flank:
                quals = joined([ord(c) - 33 for c in flank["ql"]], quals, lead)
            for key in tracks:
                tracks[key] = joined(flank.get(key, []), tracks[key], lead != TRACKS[key])
            if runs is not None:
                runs = joined(flank.get("sa", []), runs, lead)
            if modified:
                for store, name in ((sites, "MM"), (values, "ML")):
                    for prefix, piece in flank.get(name, {}).items():
                        store[prefix] = joined(piece, store.get(prefix, []), lead)
        node = node.get("nested")
    for key, track in tracks.items():
        tags[key] = {**tags[key], "ai": track}
    if runs is not None:
        tags["sa"] = {**tags["sa"], "ai": runs}
    if modified:
        tags["MM"] = {**tags["MM"], "s": format_modifications([(p, sites[p]) for p in sorted(sites)])}
        flat = [x for p in sorted(sites) for x in values.get(p, [])]
        if flat:
            tags["ML"] = {**(tags.get("ML") or {**int_value(0), "t": "B", "i": None, "et": "C"}), "ai": flat}
        if "MN" in tags:
            tags["MN"] = int_value(len(seq))
    for key in DEMULTIPLEXING:
        tags.pop(key, None)
    name = row["qname"] or ""
    consensus = name.removesuffix("/fwd").removesuffix("/rev").endswith("/ccs")
    if consensus:
        tags.pop("qs", None)
        tags.pop("qe", None)
    if "cx" in tags and tags["cx"]["t"] == "i":
        left = tags["cx"]["i"] & ~(BARCODE_BEFORE | BARCODE_AFTER)
        if left or not consensus:
            tags["cx"] = int_value(left)
        else:
            del tags["cx"]
    return row | {"seq": seq, "qual": None if quals is None else bytes(quals), "tags": _base_group(tags)}


def _base_group(tags: dict) -> dict:
    group = tags.get("RG")
    return tags | {"RG": {**group, "s": group["s"].partition("/")[0]}} if group and group["t"] == "Z" else tags


def clip_reads(reads: DataFrame, left: str = "clip_start", right: str = "clip_end") -> DataFrame:
    """Each read clipped without loss to its own window, given in two of its columns."""
    return map_records(reads, lambda row: row if row[left] is None or row[right] is None else clip_lossless(row, row[left], row[right]))


def restore_reads(reads: DataFrame) -> DataFrame:
    return map_records(reads, restore)

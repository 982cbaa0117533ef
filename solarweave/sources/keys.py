"""Columns that identify what is read: cache keys, file names, tile origins, paths, headers."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def request_key(url: Column, params: Column) -> Column:
    """sha256 of a url and its parameters (a map) as JSON with sorted keys and escaped text."""
    pairs = F.array_sort(F.map_entries(params))
    text = lambda x: F.regexp_extract(F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("x"))), r'^\{"x":(.*)\}$', 1)
    quoted = F.transform(pairs, lambda e: F.concat(text(e["key"]), F.lit(": "), text(e["value"])))
    return F.sha2(F.concat(url, F.lit("{"), F.array_join(quoted, ", "), F.lit("}")), 256)


def chip_name(name: Column) -> Column:
    """Struct year, x, y of a chip's file name: `_<year>_<km>-<km>`, in metres; null parts where it doesn't fit."""
    part = lambda i: F.regexp_extract(name, r"_(\d{4})_(\d+\.\d+)-(\d+\.\d+)", i)
    fits = name.rlike(r"_(\d{4})_(\d+\.\d+)-(\d+\.\d+)")
    metres = lambda i: F.when(fits, F.round(part(i).cast("double") * 1000).cast("long"))
    return F.struct(F.when(fits, part(1).cast("int")).alias("year"), metres(2).alias("x"), metres(3).alias("y"))


def tile_origin(name: Column) -> Column:
    """Struct east, north in metres of the token `2683-1247` in a tile's name; null where there is none."""
    token = F.regexp_extract(name, r"(?:^|_)(\d{4}-\d{4})(?:_|$)", 1)
    return F.when(token != "", F.struct((F.substring(token, 1, 4).cast("long") * 1000).alias("east"), (F.substring(token, 6, 4).cast("long") * 1000).alias("north")))


def safe_member(path: Column, allowed: tuple[str, ...] = ("images", "masks", "labels")) -> Column:
    """Whether an archive's member may be unpacked: relative, without .., in an allowed folder, no program."""
    clean = F.regexp_replace(path, r"\\", "/")
    return ~clean.startswith("/") & ~F.exists(F.split(clean, "/"), lambda p: p == "..") & F.split(clean, "/")[0].isin(*allowed) & ~F.lower(clean).rlike(r"\.(exe|dll|so|sh|bat|cmd|ps1|py)$")


def data_file(name: Column, is_folder: Column, suffixes: tuple[str, ...] = ("zip", "tif", "tiff", "png", "json")) -> Column:
    """Entries of a listing that are files of a wanted kind."""
    return ~is_folder & F.lower(name).rlike(rf"\.({'|'.join(suffixes)})$")


def wkb_offset(header: Column) -> Column:
    """Where the WKB begins in a GeoPackage geometry blob: 8 bytes of header and its envelope."""
    flags = F.conv(F.hex(F.substring(header, 4, 1)), 16, 10).cast("int")
    code = F.shiftright(flags, 1).bitwiseAND(F.lit(7))
    size = F.element_at(F.array(*map(F.lit, (0, 32, 48, 48, 64))), F.least(code, F.lit(4)) + 1)
    return F.when((F.substring(header, 1, 2) == F.lit(b"GP")) & (code <= 4), size + 8)


def wkb_polygon(blob: Column) -> Column:
    """Rings (arrays of x, y) of a polygon in a GeoPackage geometry blob, little-endian; null for what isn't one."""

    @F.udf("array<array<struct<x:double,y:double>>>", useArrow=True)
    def rings(data):
        if data is None or len(data) < 13 or data[0] != 1 or int.from_bytes(data[1:5], "little") != 3:
            return None
        out, at = [], 9
        for _ in range(int.from_bytes(data[5:9], "little")):
            n = int.from_bytes(data[at : at + 4], "little")
            if at + 4 + 16 * n > len(data):
                return None
            flat = struct.unpack_from(f"<{2 * n}d", data, at + 4)
            out.append([{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2], strict=True)])
            at += 4 + 16 * n
        return out

    offset = wkb_offset(blob)
    return rings(F.when(offset.isNotNull(), F.substring(blob, offset + 1, F.octet_length(blob))))


def plain_text(html: Column) -> Column:
    """Text without tags."""
    return F.regexp_replace(html, "<[^>]+>", "")


def system_gate(argument: Column, systems: tuple[str, ...]) -> Column:
    """Struct system, gate, digest of an argument `SYSTEM=JSON`; raises on a system that isn't known or an argument without =."""
    at = F.instr(argument, "=")
    system = F.substring(argument, F.lit(1), at - 1)
    known = F.when((at > 0) & system.isin(*systems), system).otherwise(F.raise_error(F.concat(F.lit("unknown system: "), argument)))
    text = F.substring(argument, at + 1, F.length(argument))
    return F.struct(known.alias("system"), whole_gate(text).alias("gate"), F.sha2(text, 256).alias("digest"))


def parsed_status(text: Column) -> Column:
    """The state in a status record of JSON; null where the record is broken or lacks it."""
    return F.from_json(text, "state string, epoch int")["state"]


def whole_gate(text: Column) -> Column:
    """Whether a gate file (JSON) was made with the thresholds 0.25 and 0.30 and passed."""
    g = F.from_json(text, "parameters struct<confidence:double,obstacle_confidence:double>, quality_gates struct<passed:boolean>")
    return F.coalesce((g["parameters"]["confidence"] == 0.25) & (g["parameters"]["obstacle_confidence"] == 0.30) & g["quality_gates"]["passed"], F.lit(False))

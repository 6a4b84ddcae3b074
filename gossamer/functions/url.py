"""URL, hash and id functions as Column expressions (all JVM-side unless said otherwise)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_URL = 102_400
#: Scheme, host with port, path, parameter, query and fragment of a URL.
WHOLE = r"(?s)^(?:([A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#;]*)(?:;([^?#]*))?(?:\?([^#]*))?(?:#(.*))?$"
#: Parts the pieces of a cut URL; no URL holds it.
CUT = "\x01\x02"
PARTS = ("scheme", "net_loc", "port", "path", "param", "query", "fragment")


def encode_unsafe(url: Column, strict: bool = True) -> Column:
    """Percent-encode bytes up to 0x20 and 0x7f.

    ``strict`` writes true hexadecimal; otherwise each nibble is the character '0' + nibble, so that a
    line feed becomes ``%0:``.
    """
    out = url
    for b in [*range(0x21), 0x7F]:
        code = f"%{b:02X}" if strict else "%" + chr(48 + (b >> 4)) + chr(48 + (b & 15))
        out = F.replace(out, F.lit(chr(b)), F.lit(code)) if b else out
    return out


def parse(url: Column) -> Column:
    """A struct of the seven parts; all of them null for a null or overlong URL.

    The text is trimmed, the fragment cut at ``#``, the scheme kept in its case, the host lower-cased
    without one trailing dot, ``;param`` cut at the first ``;`` of the path, an empty path after a host
    is ``/``.  One pass of one pattern cuts all parts.
    """
    u = F.regexp_replace(F.when(F.length(url) < MAX_URL - 10, url), r"^\s+|\s+$", "")
    cut = F.split(F.regexp_replace(u, WHOLE, CUT.join(f"${k}" for k in range(1, 7))), CUT, -1)
    scheme, authority, path, param, query, fragment = (F.element_at(cut, k) for k in range(1, 7))
    host = F.regexp_replace(F.lower(F.substring_index(authority, ":", 1)), r"\.$", "")
    port = F.substring(authority, F.length(F.substring_index(authority, ":", 1)) + 2, MAX_URL)
    path = F.when((path == "") & (host != ""), F.lit("/")).otherwise(path)
    return F.struct(*[c.alias(n) for c, n in zip((scheme, host, port, path, param, query, fragment), PARTS)])


def render(p: Column, fragment: bool = False, keep_port_80: bool = False) -> Column:
    """The text of parsed parts: without port 80 and, unless asked for, without fragment."""
    port = F.when((p["port"] != "") & (F.lit(keep_port_80) | (p["port"] != "80")), F.concat(F.lit(":"), p["port"])).otherwise(F.lit(""))
    tail = F.concat(
        F.when(p["param"] != "", F.concat(F.lit(";"), p["param"])).otherwise(F.lit("")),
        F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")),
        F.when((p["fragment"] != "") & F.lit(fragment), F.concat(F.lit("#"), p["fragment"])).otherwise(F.lit("")),
    )
    head = F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(F.lit(""))
    place = F.when(p["net_loc"] != "", F.concat(F.lit("//"), p["net_loc"], port)).otherwise(F.lit(""))
    return F.concat(head, place, p["path"], tail)


def canonical(url: Column) -> Column:
    """The canonical text of a URL: what ``render`` makes of its parts."""
    return render(parse(url))


def normalized(url: Column) -> Column:
    """Canonical text of http URLs with dot segments resolved, null for any other URL."""
    return F.when(F.lower(F.trim(url)).startswith("http://"), canonical(resolve(url, url)))


def resolve(relative: Column, base: Column) -> Column:
    """``relative`` seen from ``base``.

    The scheme, then host and port, then the path are inherited; ``./`` and ``../`` are resolved at the
    start of a relative path only, and a ``..`` too many leaves one leading ``/..``.  An empty reference
    is the base without fragment.
    """
    return resolve_parts(relative, parse(F.coalesce(relative, F.lit(""))), parse(base))


def resolve_parts(relative: Column, r: Column, b: Column) -> Column:
    """``resolve`` with both addresses parsed before, as separate columns."""
    own_path = F.regexp_extract(F.regexp_extract(F.trim(relative), r"(?s)^([^#?;]*)", 1), r"(?s)^(.*)$", 1)
    folder = F.regexp_replace(b["path"], r"[^/]*$", "")
    # leading ./ fall away, each leading ../ takes a folder
    steps = F.regexp_extract(own_path, r"^((?:\.\.?(?:/|$))*)", 1)
    ups = F.size(F.split(steps, r"\.\.", -1)) - 1
    rest = F.regexp_replace(own_path, r"^(?:\.\.?(?:/|$))*", "")
    names = F.filter(F.split(folder, "/"), lambda x: x != "")
    left = F.size(names) - ups
    kept = F.slice(names, 1, F.greatest(left, F.lit(0)))
    climbed = F.concat(F.when(left < 0, F.lit("/../")).otherwise(F.lit("/")), F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "/"), F.lit("/"))).otherwise(F.lit("")), rest)
    has_host, has_scheme = r["net_loc"] != "", (r["scheme"] != "")
    path = F.when(own_path == "", b["path"]).when(own_path.startswith("/"), own_path).otherwise(climbed)
    whole = F.struct(
        F.when(has_scheme, r["scheme"]).otherwise(b["scheme"]).alias("scheme"),
        F.when(has_host, r["net_loc"]).otherwise(b["net_loc"]).alias("net_loc"),
        F.when(has_host, r["port"]).otherwise(b["port"]).alias("port"),
        F.when(has_host | has_scheme, r["path"]).otherwise(path).alias("path"),
        F.when(has_host | (own_path != "") | (r["param"] != ""), r["param"]).otherwise(b["param"]).alias("param"),
        F.when(has_host | (own_path != "") | (r["query"] != "") | (r["param"] != ""), r["query"]).otherwise(b["query"]).alias("query"),
        r["fragment"].alias("fragment"),
    )
    return F.when(relative.isNotNull(), render(whole))


def extension(path: Column) -> Column:
    """Lower-case file ending of two to six characters after the last dot, else empty."""
    return F.lower(F.regexp_extract(path, r"\.([^./]{2,6})$", 1))


#: File endings by type (fixed values).
TYPES = {
    "text": "htm html shtm shtml php php3 phtml asp txt jhtml stm",
    "audio": "mp3 wav ra rm",
    "image": "jpg jpeg gif png bmp",
}


def file_type(path: Column) -> Column:
    """``text``, ``audio``, ``image`` or ``unknown``; no ending counts as text."""
    ext = extension(path)
    out = F.when(ext == "", F.lit("text"))
    for name, endings in TYPES.items():
        out = out.when(ext.isin(endings.split()), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def reverse_host(host: Column, labels_to: str = ".") -> Column:
    return F.concat_ws(labels_to, F.reverse(F.split(host, r"\.", -1)))


def reverse_server(address: Column) -> Column:
    """``www.a.com/x`` as ``com.a.www/x``."""
    return F.concat(reverse_host(F.regexp_extract(address, r"^([^/]*)", 1)), F.regexp_extract(address, r"^[^/]*(.*)$", 1))


def site_path(host: Column, prefix: str, kind: str) -> Column:
    """Folder of a site in the page store: labels reversed, ``_dot_`` for empty ones."""
    labels = F.transform(F.reverse(F.split(host, r"\.", -1)), lambda x: F.when(x == "", "_dot_").otherwise(x))
    return F.concat(F.lit(prefix), F.array_join(labels, "/"), F.lit(f"/_repository_/{kind}"))


def string_hash(text: Column) -> Column:
    """32-bit CRC without the final inversion."""
    return F.crc32(text).bitwiseXOR(F.lit(4294967295))


def url_hash(parsed: Column, mask: int = 0xFFFFFFFF) -> Column:
    """Hash of port, path, param and query: the host is left out, as each site has its own set."""
    return string_hash(F.concat(parsed["port"], parsed["path"], parsed["param"], parsed["query"])).bitwiseAND(F.lit(mask))


def doc_id(url: Column) -> Column:
    """64-bit id of a canonical URL, its lowest bit cleared."""
    return F.xxhash64(canonical(url)).bitwiseAND(F.lit(-2))


def lose_slash(i: Column) -> Column:
    return i.bitwiseAND(F.lit(-2))


def bucket(i: Column, bits: int = 6) -> Column:
    """The top bits of a 64-bit id."""
    return F.shiftrightunsigned(i, 64 - bits).cast("int")


def padded(i: Column, signed: bool = False) -> Column:
    """An id in 20 digits, unsigned unless asked for."""
    d = i.cast("decimal(20,0)")
    if signed:
        return F.format_string("%020d", i)
    return F.lpad(F.when(i < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("string"), 20, "0")


def query_fields(query: Column) -> Column:
    """The name=value map of a query string; a repeated name keeps its last value."""
    pairs = F.filter(F.split(query, "[&;]"), lambda x: x != "")
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, F.regexp_extract(x, "(?s)=(.*)$", 1)).otherwise(F.lit("")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


@lru_cache(maxsize=8)
def _table(poly: int, bits: int) -> np.ndarray:
    """Table of a non-reflected CRC, made from its polynomial."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint64)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[i] = c
    return out


@lru_cache(maxsize=8)
def _entries(poly: int, bits: int) -> list[int]:
    return [int(x) for x in _table(poly, bits)]


def crc(data: bytes, poly: int, bits: int, start: int) -> int:
    table, c, mask = _entries(poly, bits), start, (1 << bits) - 1
    for b in data:
        c = ((c << 8) & mask) ^ table[(c >> (bits - 8)) ^ b]
    return c


def _crc_column(values: pd.Series, poly: int, bits: int, start: int) -> pd.Series:
    """All texts at once: the n-th byte of every text in one step."""
    raw = [(v.encode() if isinstance(v, str) else bytes(v)) if v is not None else None for v in values]
    table, mask, shift = _table(poly, bits), np.uint64((1 << bits) - 1), np.uint64(bits - 8)
    size = np.array([len(r) if r is not None else 0 for r in raw])
    flat = np.frombuffer(b"".join(r or b"" for r in raw), np.uint8)
    base = np.cumsum(size) - size
    state = np.full(len(raw), start, np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        on = np.flatnonzero(size > k)
        s = state[on]
        state[on] = ((s << np.uint64(8)) & mask) ^ table[((s >> shift) ^ flat[base[on] + k].astype(np.uint64)).astype(np.int64)]
    out = pd.Series(state.view(np.int64), dtype="Int64")
    out[[r is None for r in raw]] = pd.NA
    return out


@F.pandas_udf(T.LongType())
def header_crc32(values: pd.Series) -> pd.Series:
    """Non-reflected CRC-32, start all ones, no final inversion (page headers)."""
    return _crc_column(values, 0x04C11DB7, 32, 0xFFFFFFFF)


@F.pandas_udf(T.LongType())
def page_crc64(values: pd.Series) -> pd.Series:
    """Non-reflected CRC-64, start all ones, as a signed number."""
    return _crc_column(values, 0xE543279765927881, 64, 0xFFFFFFFFFFFFFFFF)

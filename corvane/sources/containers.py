"""Packed web containers: an eight-byte length, metadata (CBOR), an eight-byte length, an xz-compressed tar.

Structure and versions are read by native expressions on the bytes. Only decompression and signatures run in Python, in
Arrow batches, on rows that the native checks let through.
"""

from __future__ import annotations

import io
import lzma
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.hashing import metadata_hash
from ..functions.identity import sign, verify
from ..functions.text import first_bytes, first_chars, normalized
from ..schemas import CONFIG
from .cbor import Malformed, encode, first_item

MOST_METADATA, MOST_WEB, MOST_TAR = 1024, 100 * 1024 * 1024, 30 * 1024 * 1024


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """(contract_key, state) of files, keyed by their names."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("contract_key"), F.col("content").alias("state"))


def _u64(state: Column, at: Column) -> Column:
    """The eight bytes from `at` (counted from 1) as a number; null beyond the end or from 2**63 on."""
    digits = F.hex(state.substr(at, F.lit(8)))
    return F.when((F.length(digits) == 16) & (F.substring(digits, 1, 1) < "8"), F.conv(digits, 16, 10).cast("long"))


def metadata_size(state: Column) -> Column:
    return _u64(state, F.lit(1))


def web_size(state: Column) -> Column:
    return _u64(state, F.lit(9) + metadata_size(state).try_cast("int"))


def is_container(state: Column) -> Column:
    """Lengths within their limits that add up to the size of the state."""
    meta = metadata_size(state)
    fits = F.when(meta.between(1, MOST_METADATA), web_size(state).between(1, MOST_WEB) & (F.octet_length(state) == 16 + meta + web_size(state)))
    return F.coalesce((F.octet_length(state) >= 16) & fits, F.lit(False))


def container_version(state: Column) -> Column:
    """The unsigned integer after the text key "version" in the metadata; null if there is none."""
    meta = metadata_size(state)
    digits = F.hex(state.substr(F.lit(9), meta.cast("int")))
    # The marker has to begin at a whole byte, so the first match at an even offset counts.
    rest = F.regexp_extract(digits, "^(?:..)*?6776657273696F6E(.*)$", 1)
    lead, tail = F.substring(rest, 1, 2), lambda n: F.substring(rest, 3, 2 * n)
    number = lambda n: F.when(F.length(tail(n)) == 2 * n, F.conv(tail(n), 16, 10).cast("decimal(20,0)"))
    small = F.when((rest != "") & (lead <= "17"), F.conv(lead, 16, 10).cast("decimal(20,0)"))
    found = F.coalesce(small, F.when(lead == "18", number(1)), F.when(lead == "19", number(2)), F.when(lead == "1A", number(4)), F.when(lead == "1B", number(8)))
    return F.when(meta.between(1, MOST_METADATA) & (F.octet_length(state) >= F.greatest(F.lit(16), 8 + meta)), found).cast("long")


def unpack(state: bytes | None) -> bytes | None:
    """The tar of a container, at most 30 MiB; null if its structure is broken or it isn't xz."""
    if state is None or len(state) < 16:
        return None
    size = int.from_bytes(state[:8], "big")
    if not 1 <= size <= MOST_METADATA or len(state) < 16 + size:
        return None
    web = int.from_bytes(state[8 + size : 16 + size], "big")
    packed = state[16 + size : 16 + size + web]
    if web == 0 or len(packed) < web:
        return None
    try:
        reader = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        out = reader.decompress(packed, MOST_TAR + 1)
    except lzma.LZMAError:
        return None
    return out if reader.eof and 0 < len(out) <= MOST_TAR else None


def _octal(field: bytes) -> int:
    try:
        return int(field.decode("ascii").strip("\0 ") or "0", 8)
    except ValueError:
        return 0


def member(tar: bytes, name: str) -> str | None:
    """The text of the first file whose name ends with `name`. Long names of the GNU form count, extended headers and folders
    are passed over; null if there is no such file or it isn't UTF-8."""
    at, long_name = 0, None
    while at + 512 <= len(tar) and any(header := tar[at : at + 512]):
        size, kind = _octal(header[124:136]), header[156:157]
        data, at = at + 512, at + 512 + (size + 511 & ~511)
        if kind == b"L":
            if data + size <= len(tar):
                try:
                    long_name = tar[data : data + size].decode().rstrip("\0")
                except UnicodeDecodeError:
                    long_name = None
            continue
        if kind in (b"x", b"g"):
            continue
        if kind != b"5":
            own = long_name if long_name is not None else header[:100].split(b"\0")[0].decode("utf-8", "ignore")
            if own.endswith(name) and data + size <= len(tar):
                try:
                    return tar[data : data + size].decode()
                except UnicodeDecodeError:
                    return None
        long_name = None
    return None


def container_html(state: Column, name: str = "index.html") -> Column:
    @F.arrow_udf("string")
    def page(states: pa.Array) -> pa.Array:
        return pa.array([member(tar, name) if (tar := unpack(s.as_py())) is not None else None for s in states], pa.string())

    return page(state)


def page_metadata(pages: DataFrame, html: str = "html", snippet_bytes: int = CONFIG.snippet_bytes, mini: int = CONFIG.mini_snippet_chars) -> DataFrame:
    """`pages` with title, description, snippet, mini_snippet (canonical) and metadata_hash of their HTML in place of it.
    Missing titles and descriptions are empty. Rows keep all other columns."""
    h, empty = F.col(html), F.lit("")
    limits = {"title": CONFIG.title_chars, "description": CONFIG.description_chars, "snippet": snippet_bytes, "mini_snippet": mini}

    raw = pages.withColumns({"title": F.coalesce(H.title(h), empty), "description": F.coalesce(H.description(h), empty), "_visible": F.coalesce(H.visible_text(h), empty)}).drop(html)
    cut = raw.withColumns({"snippet": first_bytes(F.col("_visible"), snippet_bytes), "mini_snippet": first_bytes(F.col("_visible"), mini)}).drop("_visible")
    texts = normalized(cut, *limits).withColumns({c: first_chars(F.col(c), n) for c, n in limits.items()})
    return texts.withColumn("metadata_hash", metadata_hash(F.col("title"), F.col("description"), F.col("snippet")))


def page_metadata_shown(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title and description as the browsing view extracts them, from the first bytes of the page: the title keeps inner
    tags, the description falls back to body text."""
    head = first_bytes(F.col(html), CONFIG.html_head_bytes)
    return pages.withColumns({"title": H.title(head, keep_inner_tags=True), "description": F.coalesce(H.description(head), H.body_text(head))}).drop(html)


def extract_containers(states: DataFrame, state: str = "state") -> DataFrame:
    """(contract_key, version, size_bytes, title, description, snippet, mini_snippet, metadata_hash) of valid containers."""
    valid = states.where(is_container(F.col(state)))
    pages = valid.select("contract_key", container_version(F.col(state)).alias("version"), F.octet_length(state).cast("long").alias("size_bytes"), container_html(F.col(state)).alias("html"))
    return page_metadata(pages.where("html IS NOT NULL"))


def holds(key: bytes, state: bytes) -> bool:
    """Whether the metadata of a container has a version above 0 and a signature of it and the packed bytes by the key. A
    signature is an array of 64 small numbers, or a byte string of 64."""
    size = int.from_bytes(state[:8], "big")
    try:
        meta = first_item(state[8 : 8 + size])
        version, signature = meta["version"], bytes(meta["signature"])
    except (Malformed, KeyError, TypeError, ValueError):
        return False
    if not isinstance(version, int) or not 0 < version < 1 << 32:
        return False
    web = int.from_bytes(state[8 + size : 16 + size], "big")
    return verify(key, struct.pack(">I", version) + state[16 + size : 16 + size + web], signature)


def signed_container(parameters: Column, state: Column) -> Column:
    """boolean: whether a signed container holds: a key of 32 bytes or more, of which the first 32 count, lengths within limits,
    and what `holds` asks for. Only rows of the right shape go to Python; bytes after the container do not matter."""
    meta = metadata_size(state)
    shape = (F.octet_length(parameters) >= 32) & meta.between(1, MOST_METADATA) & web_size(state).between(0, MOST_WEB) & (F.octet_length(state) >= 16 + meta + web_size(state))

    @F.arrow_udf("boolean")
    def check(keys: pa.Array, states: pa.Array) -> pa.Array:
        rows = zip(keys, states, strict=True)
        return pa.array([k.is_valid and s.is_valid and holds(k.as_py(), s.as_py()) for k, s in rows], pa.bool_())

    return check(F.when(shape, F.substring(parameters, 1, 32)), F.when(shape, state))


def container_latest(current: DataFrame, updates: DataFrame) -> DataFrame:
    """(contract_key, version, state) after updates: of each key the state of the highest version; an update of the same
    version or a lower one changes nothing."""
    both = current.select("contract_key", "version", "state", F.lit(1).alias("held")).unionByName(updates.select("contract_key", "version", "state", F.lit(0).alias("held")))
    best = both.where("version > 0").groupBy("contract_key").agg(F.max(F.struct("version", "held", "state")).alias("b"))
    return best.select("contract_key", "b.version", "b.state")


def container_delta(local: DataFrame, peer_versions: DataFrame) -> DataFrame:
    """Local containers that are newer than the peer's version, or unknown to it."""
    peer = peer_versions.select("contract_key", F.col("version").alias("_peer"))
    return local.join(peer, "contract_key", "left").where(F.col("_peer").isNull() | (F.col("version") > F.col("_peer"))).drop("_peer")


def _head(n: int) -> bytes:
    return bytes([n]) if n < 24 else b"\x18" + bytes([n]) if n < 256 else b"\x19" + struct.pack(">H", n) if n < 65_536 else b"\x1a" + struct.pack(">I", n) if n < 1 << 32 else b"\x1b" + struct.pack(">Q", n)


def pack(html: str, version: int, secret: bytes | None = None, name: str = "index.html", as_array: bool = True) -> bytes:
    """A container with one page; signed if a secret is given, the signature as an array of numbers or as a byte string."""
    content = html.encode()
    header = bytearray(512)
    header[: len(name)] = name.encode()
    header[100:108], header[124:136], header[156:157] = b"0000644\0", b"%011o\0" % len(content), b"0"
    header[148:156] = b" " * 8
    header[148:156] = b"%06o\0 " % sum(header)
    out = io.BytesIO()
    with lzma.open(out, "wb", preset=0) as f:
        f.write(bytes(header) + content + bytes(-len(content) % 512) + bytes(1024))
    web = out.getvalue()
    meta = (b"\xa2" if secret else b"\xa1") + b"\x67version" + _head(version)
    if secret:
        meta += b"\x69signature" + encode((list if as_array else bytes)(sign(secret, struct.pack(">I", version) + web)))
    return struct.pack(">Q", len(meta)) + meta + struct.pack(">Q", len(web)) + web


def packed_pages(pages: DataFrame, version: str = "version", html: str = "html") -> DataFrame:
    """(contract_key, state): a container of each page, in Arrow batches."""

    @F.arrow_udf("binary")
    def packed(htmls: pa.Array, versions: pa.Array) -> pa.Array:
        return pa.array([pack(h, v) if h is not None and v is not None else None for h, v in zip(htmls.to_pylist(), versions.to_pylist(), strict=True)], pa.binary())

    return pages.select("contract_key", packed(F.col(html), F.col(version)).alias("state"))

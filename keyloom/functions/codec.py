"""Keys and namespaces as bytes.

A namespace (ns) is the concatenation of (length byte, name) of its path's components, empty for
the root. So equality of paths is equality of ns, and "below a path" is a range of ns, both of
which reach the Parquet scan as pushed predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.errors import InvalidBucketName, InvalidKey

MAX_NAME, MAX_DEPTH, MAX_KEY, MAX_VALUE = 255, 16, 64 * 1024, 512 * 1024 * 1024


def as_bytes(x: bytes | bytearray | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def successor(prefix: bytes) -> bytes | None:
    """The smallest byte string above all that start with prefix; None if there is none."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def check_name(name: bytes | str) -> bytes:
    name = as_bytes(name)
    if not 1 <= len(name) <= MAX_NAME:
        raise InvalidBucketName(f"a bucket name has 1 to {MAX_NAME} bytes, not {len(name)}")
    return name


def check_path(path) -> tuple[bytes, ...]:
    path = tuple(check_name(p) for p in path)
    if not 1 <= len(path) <= MAX_DEPTH:
        raise InvalidBucketName(f"a bucket path has 1 to {MAX_DEPTH} names, not {len(path)}")
    return path


def check_entry(key: bytes, value: bytes = b"") -> None:
    if len(key) > MAX_KEY or len(value) > MAX_VALUE:
        raise InvalidKey(f"a key has at most {MAX_KEY} bytes and a value {MAX_VALUE}")


def encode_path(path) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in map(as_bytes, path))


def decode_path(ns: bytes) -> tuple[bytes, ...]:
    out, at = [], 0
    while at < len(ns):
        out.append(ns[at + 1 : at + 1 + ns[at]])
        at += 1 + ns[at]
    return tuple(out)


def internal_key(path, key: bytes) -> bytes:
    """The one-map key of an entry: the user key in the root, else a kind byte, the path, the key."""
    path = tuple(map(as_bytes, path))
    if not path:
        return key
    return (b"\x01" if len(path) == 1 else bytes([3, len(path)])) + encode_path(path) + key


def meta_key(path) -> bytes:
    """The one-map key that marks a bucket."""
    path = tuple(map(as_bytes, path))
    return (b"\x00" if len(path) == 1 else bytes([2, len(path)])) + encode_path(path)


def user_key(path, internal: bytes) -> bytes | None:
    """The user key of an internal key of that path, None for keys of others."""
    prefix = internal_key(path, b"")
    return internal[len(prefix) :] if internal.startswith(prefix) else None


# ---------------------------------------------------------------- expressions


def byte(n: Column) -> Column:
    """The single byte of an integer 0 to 255."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def ns_column(path: Column) -> Column:
    """ns of a path column (array of binary)."""
    return F.aggregate(path, F.lit(b""), lambda s, p: F.concat(s, byte(F.octet_length(p)), p))


def internal_key_column(path: Column, key: Column) -> Column:
    kind = F.when(F.size(path) == 1, F.lit(b"\x01")).otherwise(F.concat(F.lit(b"\x03"), byte(F.size(path))))
    return F.when(F.size(path) == 0, key).otherwise(F.concat(kind, ns_column(path), key))


def depth_column(ns: Column) -> Column:
    """How many names a namespace has."""
    length = lambda at: F.conv(F.hex(F.substring(ns, at, F.lit(1))), 16, 10).cast("int")
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"))

    def step(s, _):
        after = F.struct((s["at"] + length(s["at"]) + 1).alias("at"), (s["n"] + 1).alias("n"))
        return F.when(s["at"] <= F.octet_length(ns), after).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_DEPTH)), start, step, lambda s: s["n"])


def stored_key_column(ns: Column, key: Column) -> Column:
    """The one-map key of a stored entry, from its namespace alone."""
    depth = depth_column(ns)
    kind = F.when(depth == 1, F.lit(b"\x01")).otherwise(F.concat(F.lit(b"\x03"), byte(depth)))
    return F.when(F.octet_length(ns) == 0, key).otherwise(F.concat(kind, ns, key))


def user_key_column(path, internal: Column) -> Column:
    """Strips the prefix of a literal path; null for keys of other paths."""
    prefix = internal_key(path, b"")
    return F.when(F.startswith(internal, F.lit(prefix)), F.substring(internal, len(prefix) + 1, 2**31 - 1))


def int_key(n: Column, width: int = 10) -> Column:
    """Digits padded to a width, so that byte order is numeric order for numbers that fit."""
    return F.lpad(n.cast("string"), width, "0").cast("binary")

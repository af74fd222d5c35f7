"""Hash-seeded randomness.

Every random choice in the library is a pure function of (row key, seed), so a
result does not depend on partitioning, task retries or executor loss, and the
same draw can be written in plain SQL for the oracle.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def order_key(key: Column, seed: int) -> Column:
    """md5 hex of ``key|seed``: a uniformly spread, reproducible sort key."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def uniform(*parts, seed: int = 42) -> Column:
    """U[0,1) from the first 32 bits of md5(parts|seed)."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    h = F.md5(F.concat_ws("|", *cols, F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def uniform_open(*parts, seed: int = 42) -> Column:
    """U(0,1): shifted by half a step so ``ln`` never sees zero."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    h = F.md5(F.concat_ws("|", *cols, F.lit(str(seed))))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_32)


def normal(*parts, seed: int = 42) -> Column:
    """Standard normal draw by Box-Muller over two hash uniforms."""
    u1 = uniform_open(*parts, "a", seed=seed)
    u2 = uniform_open(*parts, "b", seed=seed)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it inside ``fn`` (a one-element array
    transform), so an array expression is not re-evaluated per lambda element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def normal_vector(key: Column, dim: int, seed: int = 42) -> Column:
    """``dim`` standard normal draws for ``key``: Box-Muller over 32-bit uniforms
    cut from sha256(key|block|seed); one hash serves four dimensions
    (dimension d uses block d // 4, hex slots 16*(d % 4) + [1..8] and [9..16])."""
    blocks = (dim + 3) // 4
    hashes = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)),
                         lambda b: F.sha2(F.concat_ws("|", key.cast("string"), b.cast("string"), F.lit(str(seed))), 256))

    def draw(hs):
        def one(d):
            h = F.element_at(hs, (F.floor(d / 4) + 1).cast("int"))
            start = (d % 4) * 16 + 1
            u1 = (F.conv(F.substring(h, start, F.lit(8)), 16, 10).cast("long") + F.lit(0.5)) / F.lit(TWO_32)
            u2 = (F.conv(F.substring(h, start + 8, F.lit(8)), 16, 10).cast("long") + F.lit(0.5)) / F.lit(TWO_32)
            return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)
    return let(hashes, draw)


def normal_vectors(keys, dim: int, seed: int = 42) -> np.ndarray:
    """Keys x ``dim``: the draws of ``normal_vector`` for integer keys, where the vectors are used."""
    blocks = (dim + 3) // 4
    hashed = b"".join([sha256(b"%d|%d|%d" % (k, b, seed)).digest() for k in keys for b in range(blocks)])
    u = (np.frombuffer(hashed, ">u4").reshape(-1, 2) + 0.5) / TWO_32
    drawn = np.sqrt(-2.0 * np.log(u[:, 0])) * np.cos(2.0 * 3.141592653589793 * u[:, 1])
    return drawn.reshape(-1, blocks * 4)[:, :dim]

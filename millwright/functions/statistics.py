"""Statistical column expressions: Wilson interval, complementary error function, sampling by digest, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed coefficients of a rational Chebyshev fit of erfc (relative error below 1.2e-7), highest order first.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative number."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC[0])
    for c in ERFC[1:]:
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def erfc_sql(x: str) -> str:
    poly = str(ERFC[0])
    for c in ERFC[1:]:
        poly = f"({c} + (1.0/(1.0+0.5*({x})))*{poly})"
    return f"((1.0/(1.0+0.5*({x})))*exp(-({x})*({x}) + {poly}))"


def wilson(defects: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Lower and upper score bound within [0, 1]; null for n = 0."""
    p, z2 = defects / n, z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    bound = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return bound(middle - half), bound(middle + half)


def hashed_draw(seed_hex: Column, replicate: Column, draw: Column, n: Column) -> Column:
    """First 8 bytes, as an unsigned number modulo n, of SHA-256(seed, replicate, draw), both numbers in 8 big-endian bytes."""
    pad = lambda k: F.lpad(F.hex(k), 16, "0")
    digest = F.sha2(F.unhex(F.concat(seed_hex, pad(replicate), pad(draw))), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("long")


def digest_id(namespace: str, **fields: Column) -> Column:
    """sha256:<hex> of the namespace and the fields as JSON with sorted keys (nulls written), a line each."""
    body = F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(namespace + "\n"), body, F.lit("\n")), 256))

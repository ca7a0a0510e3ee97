"""Column-level functions (pure expressions, JVM side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a 64-bit parameters (fixed values of the published hash):
# offset basis 0xcbf29ce484222325, prime 0x100000001b3 = 2^40 + 435.
FNV_OFFSET_HI = 0xCBF29CE4
FNV_OFFSET_LO = 0x84222325
FNV_PRIME_LOW = 435
CANARY_SCALE = 10_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sunday_week(ts) -> Column:
    """Week of year, weeks starting on Sunday, days before the first Sunday in week 0
    (the calendar's ``%U``). ISO ``weekofyear`` differs and is not used."""
    ts = col(ts)
    return F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7).cast("long")


def round_half_away(c, digits: int = 4) -> Column:
    """ROUND(x, digits) as SQL engines compute it on DOUBLE: half away from zero on
    the binary value x * 10^digits. (Spark's ``round`` rounds the decimal text, so
    the two differ on ties such as 173.94265.)"""
    c = col(c)
    scale = float(10 ** digits)
    r = F.floor(F.abs(c) * scale + 0.5) / scale
    return F.when(c.isNull() | F.isnan(c), c).when(c < 0, -r).otherwise(r)


def is_finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def fnv1a64_mod(c, modulus: int = CANARY_SCALE) -> Column:
    """FNV-1a 64 of the UTF-8 bytes of ``c``, reduced mod ``modulus``.

    The 64-bit state is carried as two 32-bit halves in LONG lanes so that no
    product overflows (ANSI mode raises on overflow). Multiplying by the prime
    2^40 + 435 is ``h*435 + (h << 40)``; with h = hi*2^32 + lo only ``lo`` reaches
    the upper half through the shift.
    """
    hexed = F.hex(F.encode(col(c), "UTF-8"))
    n_bytes = (F.length(hexed) / 2).cast("int")
    byte_list = F.when(n_bytes > 0, F.transform(
        F.sequence(F.lit(1), n_bytes),   # an empty text has no byte and keeps the offset basis
        lambda i: F.conv(F.substr(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long"),
    )).when(n_bytes == 0, F.array().cast("array<bigint>"))
    init = F.struct(F.lit(FNV_OFFSET_HI).cast("long").alias("hi"),
                    F.lit(FNV_OFFSET_LO).cast("long").alias("lo"))
    two32 = (1 << 32) % modulus

    def reduce(state: Column) -> Column:
        # (hi * 2^32 + lo) mod m, computed without leaving 64-bit range; in the finish
        # step, so that both halves come from one fold
        return (((state["hi"] % modulus) * two32) % modulus + state["lo"] % modulus) % modulus

    return F.aggregate(byte_list, init, lambda acc, b: _fnv_step(acc["hi"], acc["lo"].bitwiseXOR(b)), reduce)


def _fnv_step(hi: Column, lo: Column) -> Column:
    mask = F.lit(0xFFFFFFFF).cast("long")
    t = lo * FNV_PRIME_LOW
    new_hi = (hi * FNV_PRIME_LOW + F.shiftright(t, 32) + F.shiftleft(lo, 8)).bitwiseAND(mask)
    return F.struct(new_hi.alias("hi"), t.bitwiseAND(mask).alias("lo"))


def canary(click_id, ratio_bp) -> Column:
    """sticky rollout sample. 0 bp: nobody, 10 000 bp: everybody, else
    FNV-1a(click_id) mod 10 000 < bp. More than 10 000 bp is a config error."""
    bp = ratio_bp if isinstance(ratio_bp, Column) else F.lit(ratio_bp)
    return (F.when(bp > CANARY_SCALE, F.raise_error(F.lit("canary bp > 10000")).cast("boolean"))
            .when(bp == 0, F.lit(False))
            .when(bp == CANARY_SCALE, F.lit(True))
            .otherwise(fnv1a64_mod(click_id) < bp))


def clv_adjust(rpc, clv, alpha: float, reference: float, cap: float) -> Column:
    """rpc * (1 + alpha * min(clv / reference, cap)). Parameters must be finite
    and > 0. A missing, negative or non-finite CLV leaves the rpc unchanged."""
    for name, v in (("alpha", alpha), ("clv_reference", reference), ("cap", cap)):
        if not (v == v and v not in (float("inf"), float("-inf")) and v > 0):
            raise ValueError(f"{name}={v} must be finite and > 0")
    rpc, clv = col(rpc), col(clv)
    adjusted = rpc * (1.0 + alpha * F.least(clv / reference, F.lit(cap)))
    ok = is_finite(clv) & (clv >= 0) & is_finite(adjusted) & (adjusted >= 0)
    return F.when(ok, adjusted).otherwise(rpc)


def bounds_check(rpc, lo, hi) -> Column:
    """inclusive [lo, hi]."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    rpc = col(rpc)
    return (rpc >= lo) & (rpc <= hi)


def f64_text(c) -> Column:
    """Plain decimal text of a double, never with an exponent: "3", "0.0005",
    "10000000000000000". The shortest digits come from the engine's text form
    (``d.ddd`` or ``d.dddE<n>``); the point is moved by the exponent."""
    c = col(c)
    text = F.abs(c).cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    part = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(whole, part)
    point = F.length(whole) + exponent           # digits before the point
    shifted = (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
                .when(point >= F.length(digits), F.rpad(digits, point, "0"))
                .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))))
    plain = F.when(c == 0, F.lit("0")).when(exponent == 0, F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))).otherwise(shifted)
    # -0.0 prints its sign
    negative = (c < 0) | ((c == 0) & c.cast("string").startswith("-"))
    return (F.when(is_finite(c), F.when(negative, F.concat(F.lit("-"), plain)).otherwise(plain))
             .when(F.isnan(c), F.lit("NaN")).when(c > 0, F.lit("inf")).when(c < 0, F.lit("-inf")))

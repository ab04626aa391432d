"""Stable hash ranks, masks, buckets and content digests."""

from pyspark.sql import Column, DataFrame, functions as F

# Three tenths of the unsigned 64-bit range, as hexadecimal text.
MASK_LIMIT_HEX = "4ccccccccccccccc"


def stable_rank(salt: str | Column, identifier: Column) -> Column:
    """Hexadecimal SHA-256 of salt, NUL and identifier; sorts like the raw digest."""
    prefix = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat(prefix, F.lit("\0"), identifier), 256)


def prefix_mod(digest: Column, modulus: int) -> Column:
    """First eight digest bytes as an unsigned integer, modulo a small number."""
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return F.pmod(F.pmod(high, F.lit(modulus)) * F.lit((1 << 32) % modulus) + low, F.lit(modulus))


def digest_mod(digest: Column, modulus: int) -> Column:
    """The whole 256-bit digest modulo a small number, 32 bits at a time."""
    result = F.lit(0).cast("long")
    for start in range(1, 65, 8):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        result = F.pmod(result * F.lit((1 << 32) % modulus) + word, F.lit(modulus))
    return result


def cell_mask(seed: int, report_id: Column, field: Column) -> Column:
    """True for about 30 % of cells, always the same ones for a seed."""
    digest = F.sha2(F.concat(F.lit(str(seed)), F.lit("\0"), report_id, F.lit("\0"), field), 256)
    return F.substring(digest, 1, 16) < F.lit(MASK_LIMIT_HEX)


def span_selected(digest: Column) -> Column:
    return F.substring(digest, 1, 16) < F.lit(MASK_LIMIT_HEX)


def canonical_number(value: Column) -> Column:
    """Negative zero becomes zero so equal numbers share one spelling."""
    return F.when(value == 0.0, F.lit(0.0)).otherwise(value)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object with sorted keys, no spaces and a typed marker for null."""
    parts = []
    for name in sorted(fields):
        value = fields[name]
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(F.get_json_object(F.to_json(F.struct(value.alias("v"))), "$"), F.lit("{}"))))
    body = [F.regexp_replace(p, r'\{"v":(.*)\}$', "$1") for p in parts]
    body = [F.regexp_replace(p, r":\{\}$", ':{"type":"null"}') for p in body]
    return F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}"))


# Two primes below 2^31 and the base of the content root.
ROOT_PRIMES = (2_147_483_647, 2_147_483_629)
ROOT_BASE = 1_000_003
ROOT_BITS = 42  # positions below 2^42


def base_power(exponent: Column, prime: int) -> Column:
    """ROOT_BASE ^ exponent modulo `prime`, by the exponent's bits."""
    result, factor = F.lit(1).cast("long"), ROOT_BASE
    for bit in range(ROOT_BITS):
        chosen = F.when(F.shiftright(exponent, bit).bitwiseAND(F.lit(1)) == 1, F.lit(factor)).otherwise(F.lit(1))
        result = F.pmod(result * chosen.cast("long"), F.lit(prime))
        factor = factor * factor % prime
    return result


def content_root(df: DataFrame, keys: list[str], position: str, row: Column) -> DataFrame:
    """Order-sensitive digest of each key's rows: the polynomial of their hashes in position order, modulo two primes.

    `position` is the 0-based place of a row. A row's term is its hash times base ^ position, so terms add up in any partitioning,
    parts of a table can be summed apart, and a swap of two rows changes the root.
    """
    word = lambda start: F.conv(F.substring("digest_", start, 8), 16, 10).cast("long")
    hashed = df.select(*keys, F.col(position).alias("at_"), F.sha2(row, 256).alias("digest_"))
    sums = []
    for i, prime in enumerate(ROOT_PRIMES):
        term = F.pmod(F.pmod(word(8 * i + 1), F.lit(prime)) * base_power(F.col("at_"), prime), F.lit(prime))
        sums.append(F.pmod(F.sum(term.cast("decimal(38,0)")), F.lit(prime).cast("decimal(38,0)")).cast("long"))
    root = F.concat_ws("-", *[F.lpad(F.lower(F.hex(s)), 8, "0") for s in sums])
    return hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), root.alias("content_root"))


def content_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row count with the XOR and the sum of two independent row hashes."""
    row = F.struct(*sorted(df.columns))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.bit_xor(F.xxhash64(row)).alias("xor_digest"),
        F.sum(F.pmod(F.hash(row).cast("long"), F.lit(2_147_483_647))).alias("sum_digest"),
    )

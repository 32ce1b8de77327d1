"""Hash words, Hamming distances and the keyed visitor hash, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX = "0123456789ABCDEF"
_BLOCK_HEX = 128  # a SHA-256 block is 64 bytes


def _xor_hex(digits: Column, byte: int) -> Column:
    """XOR every byte of a hex string with one constant byte."""
    high = "".join(_HEX[i ^ (byte >> 4)] for i in range(16))
    low = "".join(_HEX[i ^ (byte & 15)] for i in range(16))
    pairs = F.transform(F.sequence(F.lit(1), F.lit(_BLOCK_HEX - 1), F.lit(2)), lambda i: F.concat(
        F.translate(F.substr(digits, i, F.lit(1)), _HEX, high),
        F.translate(F.substr(digits, i + 1, F.lit(1)), _HEX, low)))
    return F.array_join(pairs, "")


def hmac_pads(key: Column) -> Column:
    """struct(inner, outer) pads of a binary key of at most 64 bytes."""
    digits = F.rpad(F.hex(key), _BLOCK_HEX, "0")
    return F.struct(F.unhex(_xor_hex(digits, 0x36)).alias("inner"), F.unhex(_xor_hex(digits, 0x5C)).alias("outer"))


def hmac_sha256(pads: Column, message: Column) -> Column:
    """HMAC-SHA256 from precomputed pads; two sha2 calls per row, no Python."""
    inner = F.unhex(F.sha2(F.concat(pads["inner"], message), 256))
    return F.unhex(F.sha2(F.concat(pads["outer"], inner), 256))


def pack_bits(bits: Column) -> Column:
    """Array of up to 64 booleans, first bit most significant, as a signed bigint."""
    return F.aggregate(bits, F.lit(0).cast("bigint"),
                       lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, 1).otherwise(0).cast("bigint")))


def ahash(cells: Column) -> Column:
    """Bit set where a cell is above the frame's own mean."""
    mean = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(cells)
    return pack_bits(F.transform(cells, lambda x: x.cast("double") > mean))


def dhash(cells: Column, width: int = 9) -> Column:
    """Row-wise gradient bits of a flattened grid ``width`` cells wide."""
    index = F.filter(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: i % width != width - 1)
    return pack_bits(F.transform(index, lambda i: F.get(cells, i + 1) > F.get(cells, i)))


def ring_dhash(cells: Column) -> Column:
    """Gradient bits of a vector read as a ring: bit i says cell i+1 is above cell i."""
    n = F.size(cells)
    return pack_bits(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(cells, (i + 1) % n) > F.get(cells, i)))


def words_from_hex(seq: Column) -> Column:
    """16 hex characters per frame -> array of signed 64-bit words."""
    n = F.floor(F.length(seq) / 16).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(
        F.substr(seq, (i - 1) * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def hex_from_words(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def mean_hamming(a: Column, b: Column) -> Column:
    """Mean bits per frame over the frames both sides have; null when none."""
    n = F.least(F.size(a), F.size(b))
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(0))),
                       F.lit(0), lambda acc, d: acc + d)
    return F.when(n > 0, bits / n)


def content_version(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 12)


def versioned_name(name: Column, data: Column) -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.concat(stem, F.lit("."), content_version(data), F.lit("."), F.substring_index(name, ".", -1))


def band_values(word: Column, bands: int) -> Column:
    """The word cut into ``bands`` bit fields: array of struct(band, width, value)."""
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    parts = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        mask = (1 << (hi - lo)) - 1
        value = F.shiftrightunsigned(word, lo).bitwiseAND(F.lit(mask).cast("bigint"))
        parts.append(F.struct(F.lit(i).alias("band"), F.lit(hi - lo).alias("width"), value.alias("value")))
    return F.array(*parts)


def band_probes(word: Column, bands: int) -> Column:
    """Band values plus every one-bit neighbour: array of struct(band, value)."""
    def spread(b):
        own = F.array(F.struct(b["band"].alias("band"), b["value"].alias("value")))
        flips = F.transform(F.sequence(F.lit(0), b["width"] - 1), lambda k: F.struct(
            b["band"].alias("band"),
            b["value"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).alias("value")))
        return F.concat(own, flips)

    return F.flatten(F.transform(band_values(word, bands), spread))

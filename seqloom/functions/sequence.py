"""Column functions over DNA strings, qualities and read names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_code(base: Column | str) -> Column:
    """A, C, G, T or U, anything else as 0, 1, 2, 3, 4; case does not matter."""
    return F.coalesce(F.nullif(F.instr(F.lit("ACGT"), F.translate(F.upper(_c(base)), "U", "T")), F.lit(0)) - 1, F.lit(4))


def reverse_complement(seq: Column | str) -> Column:
    """The other strand, upper case; what is not a base becomes N."""
    up = F.regexp_replace(F.translate(F.upper(_c(seq)), "U", "T"), "[^ACGT]", "N")
    return F.reverse(F.translate(up, "ACGT", "TGCA"))


def is_acgt(seq: Column | str) -> Column:
    return _c(seq).rlike("^[ACGT]+$")


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement; strings of equal
    length sort as packed k-mers do."""
    k = _c(kmer)
    return F.least(k, F.reverse(F.translate(k, "ACGT", "TGCA")))


def packed(kmer: Column | str) -> Column:
    """Two bits for each base, up to 31 bases."""
    return F.conv(F.translate(_c(kmer), "ACGT", "0123"), 4, 10).cast("long")


def unpacked(kmer: Column | str, k: int) -> Column:
    """The k bases of a packed k-mer."""
    return F.translate(F.lpad(F.conv(_c(kmer).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def kmers(seq: Column | str, k: int) -> Column:
    """array of struct(pos, kmer) of all windows of k bases."""
    s = _c(seq)
    cut = lambda i: F.struct(i.alias("pos"), s.substr(i + 1, F.lit(k)).alias("kmer"))
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(0), F.length(s) - k), cut)).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))


def canonical_kmers(seq: Column | str, k: int) -> Column:
    """array of struct(pos, kmer, rc) of the canonical k-mers; the other strand
    is made once for the whole sequence, not for each window."""
    s = _c(seq)
    back = F.reverse(F.translate(s, "ACGT", "TGCA"))
    n = F.length(s)

    def cut(i):
        a, b = s.substr(i + 1, F.lit(k)), back.substr(n - i - k + 1, F.lit(k))
        return F.struct(i.alias("pos"), F.least(a, b).alias("kmer"), (b < a).alias("rc"))

    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), cut)).otherwise(F.array().cast("array<struct<pos:int,kmer:string,rc:boolean>>"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing places of two strings, over the shorter one's length."""
    a, b = _c(a), _c(b)
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.isNotNull() & y.isNotNull() & (x != y)), lambda d: d))


def phred(qual: Column | str) -> Column:
    """Error exponent of one quality character."""
    return F.greatest(F.ascii(_c(qual)) - 33, F.lit(0))


def error_rate(q: Column | str) -> Column:
    return F.pow(F.lit(10.0), -_c(q) / 10.0)


def qualities(qual: Column | str) -> Column:
    return F.transform(F.split(_c(qual), ""), lambda c: F.greatest(F.ascii(c) - 33, F.lit(0)))


def expected_errors(qual: Column | str) -> Column:
    return F.aggregate(qualities(qual), F.lit(0.0), lambda s, q: s + F.pow(F.lit(10.0), -q / 10.0))


def quality_bin(q: int, bins: int) -> int:
    """The value that stands for Phred q: 4 bins, 2 bins, or equal bands over 0..42."""
    q = min(max(q, 0), 42)
    if bins == 4:
        return 2 if q < 3 else 12 if q < 15 else 23 if q < 27 else 37
    if bins == 2:
        return 10 if q < 20 else 35
    return min(q * bins // 43, bins - 1) * 42 // (bins - 1)


def binned_quality(qual: Column | str, bins: int) -> Column:
    """A quality string with every character replaced by its bin's."""
    every = "".join(chr(33 + q) for q in range(94))
    return F.translate(_c(qual), every, "".join(chr(33 + quality_bin(q, bins)) for q in range(94)))


def passes_tail(seq: Column | str, qual: Column | str) -> Column:
    """No N, and none of the last max(1, int(0.12 n)) qualities is 2 or less."""
    s, q = _c(seq), _c(qual)
    tail = F.greatest(F.lit(1), F.floor(F.length(q) * 0.12).cast("int"))
    return ~s.rlike("[Nn]") & ~F.right(q, tail).rlike("[!\"#]")


def zigzag(n: Column | str) -> Column:
    n = _c(n).cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column | str) -> Column:
    n = _c(n)
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1)))


def varint_bytes(n: Column | str) -> Column:
    """Bytes of an unsigned value at seven bits each."""
    bits = F.length(F.bin(_c(n)))
    return F.greatest(F.ceil(bits / 7), F.lit(1)).cast("int")


def mapq(mismatches: Column | str) -> Column:
    return F.greatest(F.lit(0), 60 - 6 * _c(mismatches))


def select_k(length: Column | str, low: int = 15, default: int = 21, high: int = 25) -> Column:
    n = _c(length)
    return F.when(n <= 50, low).when(n >= 250, high).otherwise(default)


def digit_tokens(name: Column | str) -> Column:
    """Runs of digits and of other characters."""
    return F.regexp_extract_all(_c(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))


def field_tokens(name: Column | str) -> Column:
    """Separator runs, and what is between them: split into digit runs and
    others if that makes at most two pieces, whole if not."""
    fields = F.regexp_extract_all(_c(name), F.lit(r"([._:=/ -]+|[^._:=/ -]+)"), F.lit(1))
    return F.flatten(F.transform(fields, lambda f: F.when(F.size(digit_tokens(f)) <= 2, digit_tokens(f)).otherwise(F.array(f))))


def regime(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s < 0.05, "AMPLICON").when(s < 0.15, "TARGETED").when(s < 0.35, "WGS").otherwise("METAGENOMIC")


def substitution_rank(ref: Column | str, base: Column | str) -> Column:
    """The rank of base among the three bases that are not ref; 3 if it is ref
    or no base."""
    r, b = base_code(ref), base_code(base)
    return F.when((b > 3) | (b == r), 3).otherwise(b - F.when(b > r, 1).otherwise(0))


def substituted(ref: Column | str, rank: Column | str) -> Column:
    """The base of a rank among those that are not ref."""
    r, k = base_code(ref), _c(rank)
    return F.lit(BASES).substr(k + F.when(k >= r, 1).otherwise(0) + 1, F.lit(1))


def tandem_in(seq: Column | str, flank: Column | str) -> Column:
    """Whether seq, of two bases or more, repeats a unit of up to four bases
    that occurs in flank."""
    s, f = _c(seq), _c(flank)
    one = lambda u: (F.length(s) >= u) & (F.repeat(s.substr(1, u), 16).substr(F.lit(1), F.length(s)) == s) & (F.instr(f, s.substr(1, u)) > 0)
    return (F.length(s) >= 2) & (one(1) | one(2) | one(3) | one(4))


LOW32 = 0xFFFFFFFF
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211  # fixed values of FNV-1a
FMIX = ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53))  # fixed values of the fmix64 finalizer
SPLITMIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))  # fixed values of splitmix64's finalizer


def _signed(c: int) -> int:
    return c - (1 << 64) if c >> 63 else c


def _halves(x: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(LOW32))


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(LOW32)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))


def wrapping_multiply(x: Column, c: int) -> Column:
    """x * c modulo 2^64, from products of 32 by 16 bits."""
    high, low = _halves(x)
    part = lambda h, i: h * ((c >> (16 * i)) & 0xFFFF)
    low16 = lambda v: F.shiftleft(v.bitwiseAND(F.lit(0xFFFF)), 16)
    first = part(low, 0) + low16(part(low, 1))
    carry = F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(part(low, 1), 16)
    cross = part(low, 2) + low16(part(low, 3)) + part(high, 0) + low16(part(high, 1))
    return _joined(carry + cross, first)


def fnv1a(text: Column | str) -> Column:
    """FNV-1a of the characters' low bytes, 64 bits."""
    step = lambda h, c: wrapping_multiply(h.bitwiseXOR(F.ascii(c).cast("long")), FNV_PRIME)
    return F.aggregate(F.filter(F.split(_c(text), ""), lambda c: c != ""), F.lit(_signed(FNV_START)), step)


def _mixed(x: Column, steps: tuple, last: int) -> Column:
    """Folds by a shift, each with its product, and a last fold. Each step's
    value is computed once, however often the next one names it."""
    fed = lambda v, step: F.transform(F.array(v), step)[0]
    folded = lambda shift: lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift))
    product = lambda c: lambda v: wrapping_multiply(v, c)
    for shift, c in steps:
        x = fed(fed(x, folded(shift)), product(c))
    return fed(x, folded(last))


def fmix(x: Column | str) -> Column:
    """The 64-bit finalizer that spreads packed k-mers."""
    return _mixed(_c(x).cast("long"), FMIX, 33)


def splitmix(x: Column | str) -> Column:
    """The finalizer of splitmix64, which spreads bucket numbers."""
    return _mixed(_c(x).cast("long"), SPLITMIX, 31)


def shifted_distance(a: Column | str, b: Column | str, most: int) -> Column:
    """The least (2 mismatches + |shift|) / length of a, over shifts of b by up
    to most places either way; 1 if either is empty."""
    a, b = _c(a), _c(b)
    n, m = F.length(a), F.length(b)

    def cost(shift: int) -> Column:
        x, y = max(shift, 0), max(-shift, 0)
        size = F.least(n - x, m - y)
        differ = hamming(a.substr(F.lit(x + 1), size), b.substr(F.lit(y + 1), size))
        return F.when(size > 0, 2 * differ + abs(shift))

    best = F.least(*[cost(s) for s in range(-most, most + 1)]) if most else cost(0)
    return F.when((n == 0) | (m == 0), 1.0).otherwise(F.coalesce(best, 2 * n * n) / n)


def around(seq: Column | str, pos: Column | str) -> Column:
    """The base before, at and after a place as one number of base 5; 4 where there is none."""
    s, p = _c(seq), _c(pos)
    at = lambda i: F.when((i < 0) | (i >= F.length(s)), 4).otherwise(base_code(s.substr(i + 1, F.lit(1))))
    return (at(p - 1) * 5 + at(p)) * 5 + at(p + 1)

"""Line deduplication within a few edits, in DataFrame operations only.

A line goes when an earlier one (smaller document id, or a smaller line number of the same document) is equal to it, within
``edits`` edits of characters, or, with ``per_words``, within one edit of a word for each ``per_words`` words of the longer line.
Lines are judged on the input, not on what is left. Of lines of fewer than ``min_chars`` characters
only those of ``exact_chars`` or more go, and only where they equal an earlier line; lines of nothing but white space then stay.

Texts are read where they lie: what is shuffled are hashes of lines, keys, and the few lines that have to be compared.

1. Equal lines meet by two 64-bit hashes; all but the first are marked. From here on a line stands for all lines equal to it.
2. Segment partition: a line of length l is cut into ``edits`` + 1 segments. Of two lines within ``edits`` edits one segment of
   the shorter is a substring of the longer, close to the same place. Each line probes, for each length it can be
   matched with, only the places that can hold the segment (multi-match-aware selection). Keys carry length, segment number and content.
   With ``per_words``, only lines of few words need such keys: an edit of a character changes two words at most, so longer lines meet by their words.
3. Edits of words: with t edits, all but t words of either line are in the other. In any order of all words the first t + 1 distinct words
   of both lines therefore have one in common, and the first t + 2 have two. Long words come first, being rare. A line has a key for each of these
   words, together with its band of lengths and, where it lies near enough to the lower end of that band, the band below. A line with too few
   distinct words has keys for all of them and for those that occur 2, 4, 8 ... times.
4. Members of a bucket meet by a join of the keys with themselves, and parities of the words' hash classes rule pairs out there.
5. Buckets of more than ``HOT`` lines are not paired. Their lines are compared with the earliest of the bucket; those that have no earlier partner by then
   meet the others by two words instead of one (or by the segment), again only if the parities allow it.
   A line is looked at against the earlier line whose parities are most like its own; only if that is not near it, against the others.
6. Pairs are verified with a banded bit-parallel edit distance: the 2 * ``edits`` + 1 cells of a column that matter are bits of one number that slides
   down with each character; or by the edit distance of words, each word standing as one character (words are told apart by 64-bit hashes).

Edge cases: null text is empty and has no lines to lose; a document whose lines all go becomes an empty text; rows that share an id are
ordered by the digest of their texts, and rows that agree in both are one document and keep the same lines; rows with a null id keep all lines, which no other
line is held against; columns other than the two named ones pass through untouched, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from utilmine.llm import common
from utilmine.llm.common import as_text, fresh_name, materialise, release, small_side


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed one time for each row. A projection's filters are pushed below it, where they would spell the expression out again at each use."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is ``edits`` at most, else a larger number.

    Bit k of the band at column j stands for row j - edits + k. Vertical differences of the previous column are
    kept aligned with the present band, so the band slides by shifting right. The score is followed down the lower
    border of the band while that lies inside the pattern, then along the pattern's last row.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    one, full = F.lit(1).cast("long"), F.lit(mask).cast("long")

    def flip(x: Column) -> Column:
        return x.bitwiseXOR(full)

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    # letters and lengths are bound once: an expression inside a step would be computed again for each character
    def distance(of: Column) -> Column:
        def equal_bits(j: Column) -> Column:
            letter = F.get(of["b"], j - 1)
            bits = [F.when(F.get(of["a"], j - 1 - edits + k) == letter, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]
            total = bits[0]
            for x in bits[1:]:
                total = total + x
            return total.cast("long")

        def step(state: Column, column: Column) -> Column:
            eq, j = column["eq"], column["j"]
            vp, vn = state["vp"], state["vn"]
            diagonal = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(full)

            def after(d0: Column) -> Column:
                return let(F.struct(vn.bitwiseOR(flip(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn"), d0.alias("d0")), finish)

            def finish(h: Column) -> Column:
                hp, hn, d0 = h["hp"], h["hn"], h["d0"]
                down = F.shiftright(d0, 1)
                below = F.when(d0.bitwiseAND(F.lit(top).cast("long")) == 0, 1).otherwise(0)
                place = F.call_function("shiftright", F.lit(top).cast("long"), j - (of["n"] - edits))
                along = F.when(hp.bitwiseAND(place) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(place) != 0, 1).otherwise(0)
                score = state["d"] + F.when(j <= of["n"] - edits, below).otherwise(along)
                return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("d"))

            return let(diagonal, after)

        columns = F.transform(F.sequence(F.lit(1), of["m"]), lambda j: F.struct(j.alias("j"), equal_bits(j).alias("eq")))
        start = F.struct(F.lit(mask ^ ((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).alias("d"))
        return F.aggregate(columns, start, step, lambda s: s["d"])

    both = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.char_length(a).alias("n"), F.char_length(b).alias("m"))
    within = (F.abs(F.char_length(a) - F.char_length(b)) <= edits) & (F.char_length(a) > edits) & (F.char_length(b) > 0)
    return F.when(within, let(both, distance)).otherwise(F.lit(edits + 1))


def differing_parts(lines: DataFrame, edits: int, a: str = "line", b: str = "line2") -> DataFrame:
    """Add ``part_a`` and ``part_b``: what is left of two lines without equal beginnings and ends, which edit distance ignores.

    Beginnings and ends are compared in sixteenths of the shorter line, and an eighth of it always stays.
    """
    sixteenths = 16
    n, m = F.char_length(a), F.char_length(b)
    sized = lines.withColumns({"n": n, "m": m, "w": F.floor(F.least(n, m) / sixteenths).cast("int")})
    w = F.when(F.least("n", "m") >= 8 * (edits + 2), F.col("w")).otherwise(0)
    steps = range(1, sixteenths - 1)
    x, y = F.col(a), F.col(b)
    begins = F.greatest(F.lit(0), *(F.when(F.substring(x, F.lit(1), w * k) == F.substring(y, F.lit(1), w * k), k).otherwise(0) for k in steps))
    ends = F.greatest(F.lit(0), *(F.when(F.substring(x, F.col("n") - w * k + 1, w * k) == F.substring(y, F.col("m") - w * k + 1, w * k), k).otherwise(0) for k in steps))
    cut = sized.withColumns({"begins": begins, "ends": ends}).withColumns({"skip": F.col("begins") * w, "tail": F.least(F.col("ends"), F.lit(sixteenths - 2) - F.col("begins")) * w})
    return cut.withColumns({f"part_{c}": F.substring(t, F.col("skip") + 1, F.col(size) - F.col("skip") - F.col("tail")) for c, t, size in (("a", x, "n"), ("b", y, "m"))})


def spelled(words: Column) -> Column:
    """A text with one character for each word, which a hash of 20 bits chooses."""
    low = F.lit((1 << 20) - 1).cast("long")
    codes = F.transform(words, lambda w: F.lpad(F.hex(F.xxhash64(w).bitwiseAND(low) + 0x10000), 8, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def ambiguous(words: Column) -> Column:
    """Those of an array's distinct words (numbers of 64 bits) that share a character of ``spelled`` with another one."""
    low = F.lit((1 << 20) - 1).cast("long")

    def clashes(x: Column) -> Column:
        ahead, behind = F.slice(x, 2, F.size(x)), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
        both = F.zip_with(behind, ahead, lambda u, v: F.when(u["low"] == v["low"], F.array(u["w"], v["w"])))
        return F.array_distinct(F.flatten(F.array_compact(both)))

    by_character = F.sort_array(F.transform(words, lambda w: F.struct(w.bitwiseAND(low).alias("low"), w.alias("w"))))
    return F.element_at(F.transform(F.array(by_character), clashes), 1)


def word_distance(a: Column, b: Column, most: Column) -> Column:
    """Edit distance of two arrays of words (numbers of 64 bits) if it is ``most`` at most, else -1.

    A word is its character of ``spelled``. Words that would share one with another word of the two arrays, which are few, get characters of
    their own by their place among such words.
    """
    low = F.lit((1 << 20) - 1).cast("long")

    def told_apart(of: Column, words: Column) -> Column:
        def code(w: Column) -> Column:
            own = F.array_position(of["shared"], w).cast("long") + 31
            own = own + F.when(own >= 0xD800, 0x800).otherwise(0)
            return F.lpad(F.hex(F.when(own > 31, own).otherwise(w.bitwiseAND(low) + 0x10000)), 8, "0")

        return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-32")

    def distance(of: Column) -> Column:
        return F.call_function("levenshtein", told_apart(of, of["a"]), told_apart(of, of["b"]), of["most"])

    of = F.struct(ambiguous(F.array_union(a, b)).alias("shared"), a.alias("a"), b.alias("b"), most.cast("int").alias("most"))
    return F.element_at(F.transform(F.array(of), distance), 1)


def with_segment_keys(lines: DataFrame, edits: int, min_chars: int, wanted: Column) -> DataFrame:
    """Add ``segments``: even hashes of a line's own segments, and of the places where it may hold a segment of a line shorter by up to ``edits``; null unless ``wanted``."""
    parts, cuts, out = edits + 1, {}, []
    # segment width and how many segments are one longer, for each length that is probed
    for shorter in range(parts):
        cuts |= {f"base{shorter}": F.floor((F.col("size") - shorter) / parts).cast("int"), f"rest{shorter}": (F.col("size") - shorter) % parts}
    for shorter in range(parts):
        length, base, rest = F.col("size") - shorter, F.col(f"base{shorter}"), F.col(f"rest{shorter}")
        for i in range(parts):
            width = base + F.when(rest >= parts - i, 1).otherwise(0)
            place = base * i + F.greatest(F.lit(0), rest - (parts - i))
            for off in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                fits = (length >= min_chars) & (place + off >= 0) & (place + off + width <= F.col("size"))
                out.append(F.when(fits, F.xxhash64(length, F.lit(i), F.substring(F.col("line"), place + off + 1, width))))
    sized = lines.withColumn("size", F.char_length("line")).withColumns(cuts)
    even = F.lit(-2).cast("long")
    # inside transform: spelled out in one compiled method, so many keys would be too long a method for the JVM to optimise
    return sized.withColumn("segments", F.when(wanted, F.transform(F.array(*out), lambda k: k.bitwiseAND(even)))).drop("size", *cuts)


def word_codes(words: Column) -> Column:
    """A number for each word. Each byte of a word halves it, so long words, which are rare, tend to have the smallest ones."""
    return F.transform(words, lambda w: F.call_function("shiftrightunsigned", F.xxhash64(w), F.least(F.octet_length(w), F.lit(40))))


def with_first_tokens(lines: DataFrame, n: Column) -> DataFrame:
    """Add ``tokens``: the first ``n`` distinct codes in ascending order. Where there are too few, all of them, and a token for each word that occurs 2, 4, 8 ... times."""
    codes, distinct = F.col("codes"), F.col("tokens")

    def often(j: Column) -> Column:
        times = F.call_function("shiftleft", F.lit(1), j)
        left = F.greatest(F.size(codes) - times + 1, F.lit(0))
        same = F.array_compact(F.zip_with(F.slice(codes, 1, left), F.slice(codes, times, left), lambda x, y: F.when(x == y, x)))
        return F.transform(F.array_distinct(same), lambda c: F.xxhash64(c, j))

    few = F.concat(distinct, F.flatten(F.transform(F.sequence(F.lit(1), F.floor(F.log2(F.size(codes) + 1)).cast("int") + 1), often)))
    lines = lines.withColumn("tokens", F.array_distinct("codes"))
    return lines.withColumn("tokens", F.when(F.size(distinct) >= n, F.slice(distinct, 1, n)).otherwise(few))


def length_bands(n: Column, per_words: int, edits: int) -> Column:
    """The band of a number of words, and the band of the shortest line that it can be matched with. A band is wider than all of these."""
    step = log(1 + 6 / per_words)

    def band(x: Column) -> Column:
        return F.floor(F.log(x) / step).cast("int")

    shorter = F.greatest(F.floor(n / per_words), F.when(n >= _least_words(edits, per_words), F.lit(edits)).otherwise(0))
    return F.array_distinct(F.array(band(n), band(n - shorter)))


def word_keys(tokens: Column, bands: Column) -> Column:
    """An odd hash for each token in each band."""
    return F.flatten(F.transform(bands, lambda b: F.transform(tokens, lambda x: F.xxhash64(x, b).bitwiseOR(F.lit(1).cast("long")))))


#: Lines of so many words or more have parities of 128 classes, others of 64 (into which 128 fold).
LONG_LINE = 90
#: From so many words on parities are of 256 classes: two edits of a word in ten change as many of 128 as chance does.
WIDE_LINE = 180
PARITIES = ("p", "q", "r", "s")
PROFILE = ("n", *PARITIES)


def parities(codes: Column, n: Column) -> tuple[Column, ...]:
    """Parities of how many words are in each hash class, 64 to a number; an edit of a word changes two of them at most."""

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63).cast("long")).cast("int"))

    def of(these: Column) -> Column:
        return F.aggregate(these, F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))

    def part(mask: int, which: int) -> Column:
        return of(F.filter(codes, lambda c: c.bitwiseAND(F.lit(mask).cast("long")) == which))

    none = F.lit(0).cast("long")
    half = [F.when(n < WIDE_LINE, part(64, 64 * i)).otherwise(part(192, 64 * i)) for i in (0, 1)]
    return F.when(n < LONG_LINE, of(codes)).otherwise(half[0]), F.when(n < LONG_LINE, none).otherwise(half[1]), *(F.when(n < WIDE_LINE, none).otherwise(part(192, 64 * i)) for i in (2, 3))


def differing(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How many parities of two lines differ, of as many classes as the shorter line has."""
    p, q, r, s = (a[c].bitwiseXOR(b[c]) for c in PARITIES)
    shorter = F.least(a["n"], b["n"])
    wide = F.bit_count(p) + F.bit_count(q) + F.bit_count(r) + F.bit_count(s)
    long = F.bit_count(p.bitwiseXOR(r)) + F.bit_count(q.bitwiseXOR(s))
    return F.when(shorter < LONG_LINE, F.bit_count(p.bitwiseXOR(q).bitwiseXOR(r).bitwiseXOR(s))).when(shorter < WIDE_LINE, long).otherwise(wide)


def may_match(a: dict[str, Column], b: dict[str, Column], edits: int, per_words: int, differ: Column | None = None) -> Column:
    """Whether numbers of words ``n`` and parities leave it open that two lines are near; ``differ`` is their ``differing``, if that is known."""
    longer, apart = F.greatest(a["n"], b["n"]), F.abs(a["n"] - b["n"])
    differ = differing(a, b) if differ is None else differ
    # an edit of a word changes two parities at most; an edit of a character takes away or adds three words at most
    characters = (apart <= edits) & (differ <= 3 * edits)
    return ((per_words * apart <= longer) & (per_words * differ <= 2 * longer)) | characters if per_words else characters


def _words(line: str) -> Column:
    line = F.col(line)
    plain = ~(line.contains("\t") | line.contains("\r") | line.contains("\f") | line.contains("\v") | line.contains("  ") | line.startswith(" ") | line.endswith(" "))
    return F.when(plain, F.split(line, " ")).otherwise(F.array_remove(F.split(line, r"\s+"), ""))


def _profiled(lines: DataFrame) -> DataFrame:
    """Add codes of the words in ascending order, their number ``n`` and parities."""
    coded = lines.withColumn("codes", F.sort_array(word_codes(_words("line")))).withColumn("n", F.size("codes"))
    return coded.withColumns(dict(zip(PARITIES, parities(F.col("codes"), F.col("n")))))


def _least_words(edits: int, per_words: int) -> int:
    """From so many words on, lines within ``edits`` edits of characters meet by words: few enough of their words differ, and bands are wider than ``edits``."""
    return per_words * max(2, edits) // 2


def _reach(n: Column, per_words: int, edits: int) -> Column:
    """The most words of a line of ``n`` words that a line near it can lack.

    Of a line's words, a longer partner with t edits lacks t less the difference in length, which is never more than a partner of the same length may lack.
    An edit of a character changes two words at most.
    """
    return F.greatest(F.floor(n / per_words), F.when(n >= _least_words(edits, per_words), F.lit(2 * edits)).otherwise(0)).cast("int")


#: Lines of a bucket up to which all of them meet.
HOT = 1024


def line_keys(lines: DataFrame, edits: int, min_chars: int, per_words: int) -> DataFrame:
    """(key, h1, n, parities) of (h1, line). Keys of words are odd, keys of segments are even."""
    keyed = _profiled(lines)
    if per_words:
        keyed = with_first_tokens(keyed, _reach(F.col("n"), per_words, edits) + 1).withColumn("bands", length_bands(F.col("n"), per_words, edits))
        words = F.when(F.col("n") >= per_words - 1, word_keys(F.col("tokens"), F.col("bands")))
        keyed = with_segment_keys(keyed, edits, min_chars, F.col("n") < _least_words(edits, per_words) + edits)
    else:
        words = F.lit(None).cast("array<bigint>")
        keyed = with_segment_keys(keyed, edits, min_chars, F.lit(True))
    keys = F.concat(*(F.coalesce(x, F.array().cast("array<bigint>")) for x in (words, F.col("segments"))))
    return keyed.select(F.explode(keys).alias("key"), "h1", *PROFILE).where("key IS NOT NULL")


def candidates(keyed: DataFrame, edits: int, per_words: int) -> DataFrame:
    """(key, h1, h1_2, differ, n, parities): hashes of pairs of lines of small buckets that may match and how many of their parities differ; for each line of a hot bucket the other columns instead."""
    bucket = Window.partitionBy("key").orderBy("h1")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = keyed.select("*", F.lag("h1").over(bucket).alias("before"), F.max("h1").over(whole).alias("high"))
    # each line once, and only where another line is in the bucket
    shared = placed.where("CASE WHEN before IS NULL THEN high != h1 ELSE before != h1 END").drop("before")
    shared = shared.withColumn("hot", F.count("*").over(whole) > HOT)
    ahead = shared.where(F.col("hot") | (F.col("h1") != F.col("high"))).drop("high")
    behind = shared.where(~F.col("hot")).select("key", *(F.col(c).alias(f"{c}_2") for c in ("h1", *PROFILE)))
    own, their = ({c: F.col(f"{c}{x}") for c in PROFILE} for x in ("", "_2"))
    # both sides are the same exchange; a line of a hot bucket meets nothing here and comes out once
    met = ahead.join(behind, (ahead["key"] == behind["key"]) & (F.col("h1") < F.col("h1_2")) & may_match(own, their, edits, per_words), "left")
    met = met.where(F.col("hot") | F.col("h1_2").isNotNull())
    return met.select(F.when(F.col("hot"), ahead["key"]).alias("key"), "h1", "h1_2", differing(own, their).cast("short").alias("differ"), *(F.when(F.col("hot"), F.col(c)).alias(c) for c in PROFILE))


def near_lines(lines: DataFrame, edits: int, min_chars: int, per_words: int, scratch: list[DataFrame]) -> DataFrame:
    """(id, at) of the lines of (id, at, line) that are near an earlier line but not equal to it, where they come first. ``scratch`` gets the tables to be released once the result is written."""

    def materialise(df: DataFrame, what: str) -> DataFrame:
        scratch.append(written := common.materialise(df, what))
        return written

    hashed = lines.withColumn("h1", F.xxhash64("line"))
    met = materialise(candidates(line_keys(hashed.select("h1", "line"), edits, min_chars, per_words), edits, per_words), "line-keys")
    paired = F.col("h1_2").isNotNull().alias("paired")
    wanted = met.select("h1", paired).unionByName(met.where("h1_2 IS NOT NULL").select(F.col("h1_2").alias("h1"), paired)).groupBy("h1").agg(F.max("paired").alias("paired"))
    wanted = materialise(wanted, "lines-wanted")
    occurs = hashed.join(small_side(wanted, wanted.count()), "h1").select("h1", F.xxhash64(F.lit(17), "line").alias("h2"), "paired", F.struct("id", "at", "line").alias("x"))
    firsts = occurs.groupBy("h1", "h2").agg(F.min("x").alias("x"), F.max("paired").alias("paired")).select("h1", "x.id", "x.at", "x.line", "paired")
    words = _words("line")
    described = {"spelled": spelled(words), "words": F.transform(words, lambda w: F.xxhash64(w))}
    # most lines of hot buckets are never compared, so their words wait
    firsts = firsts.withColumns({"n": F.size(words), "size": F.char_length("line"), **{c: F.when(F.col("paired"), x) for c, x in described.items()}}).drop("paired")
    firsts = materialise(firsts, "lines")

    def other(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}_2" for c in df.columns if c != "key"})

    numbers = 16 if isinstance(lines.schema["id"].dataType, StructType) else 5

    def with_both(pairs: DataFrame, n: int, sides: DataFrame, *keys: str) -> DataFrame:
        """Pairs with the columns of both lines. While ``n`` pairs are few enough to be sent to the lines, only lines of pairs are shuffled, and once."""
        theirs, far = [f"{k}_2" for k in keys], other(sides)
        sent = small_side(pairs, n, numbers)
        if sent is not pairs:
            far = far.join(small_side(pairs.select(*theirs).distinct(), n, numbers), theirs, "left_semi")
        return sides.join(sent, list(keys)).join(far, theirs)

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs (id, at, n, size, spelled and so on) that can be within a threshold, and by which: words that share a character only bring lines closer."""
        characters = F.abs(F.col("size") - F.col("size_2")) <= edits
        if per_words:
            most = F.floor(F.greatest("n", "n_2") / per_words).cast("int")
            reworded = (most > 0) & (F.abs(F.col("n") - F.col("n_2")) <= most)
            characters = characters & (F.greatest("n", "n_2") < 2 * edits * per_words)
            # an edit of a character is two edits of words at most, so one look at the words serves both thresholds
            limit = F.greatest(F.when(reworded, most).otherwise(-1), F.when(characters, 2 * edits).otherwise(-1))
            pairs = once(pairs, "apart", F.when(limit >= 0, F.call_function("levenshtein", F.col("spelled"), F.col("spelled_2"), limit)).otherwise(-1))
            pairs = pairs.where("apart >= 0").withColumn("reworded", reworded & (F.col("apart") <= most))
            characters = characters & ~F.col("reworded")
        else:
            pairs = pairs.withColumn("reworded", F.lit(False))
        pairs = pairs.withColumn("characters", characters).where(F.col("reworded") | F.col("characters"))
        return materialise(pairs.select("id", "at", "id_2", "at_2", "reworded", "characters"), "close-lines")

    def later(pairs: DataFrame, sides: DataFrame) -> DataFrame:
        """The (id, at) of the later line of each close pair that is within the threshold. A pair is looked at for one of the two thresholds and fetches only what that needs."""
        n = pairs.count()
        pairs = pairs.where((F.col("id") != F.col("id_2")) | (F.col("at") != F.col("at_2")))

        def read(which: str, *columns: str) -> DataFrame:
            return with_both(pairs.where(which).select("id", "at", "id_2", "at_2"), n, sides.select("id", "at", *columns), "id", "at")

        last = F.greatest(F.struct("id", "at"), F.struct(F.col("id_2").alias("id"), F.col("at_2").alias("at")))
        parts = differing_parts(read("characters", "line"), edits, b="line_2")
        near = once(parts, "distance", banded_distance(F.col("part_a"), F.col("part_b"), edits)).where(F.col("distance") <= edits).select(last.alias("last"))
        if per_words:
            most = F.floor(F.greatest("n", "n_2") / per_words).cast("int")
            # characters that several words share only bring lines closer: without such words the first look was exact
            both = once(read("reworded", "n", "words"), "shared", ambiguous(F.array_union("words", "words_2")))
            sure = F.when(F.size("shared") == 0, True).otherwise(word_distance(F.col("words"), F.col("words_2"), most) >= 0)
            near = near.unionByName(once(both, "near", sure).where("near").select(last.alias("last")))
        return near.select("last.id", "last.at").distinct()

    def compared(pairs: DataFrame, sides: DataFrame) -> DataFrame:
        return later(close(with_both(pairs, pairs.count(), sides.select("id", "at", "n", "size", "spelled"), "id", "at")), sides)

    def described_lines(pairs: DataFrame) -> DataFrame:
        """What ``firsts`` says of the lines of pairs from hot buckets, with their words."""
        named = materialise(pairs.select("id", "at").unionByName(pairs.select(F.col("id_2").alias("id"), F.col("at_2").alias("at"))).distinct(), "lines-wanted")
        lines = firsts.join(small_side(named, named.count(), numbers // 2), ["id", "at"], "left_semi")
        return materialise(lines.withColumns({c: F.coalesce(c, x) for c, x in described.items()}), "lines")

    place = F.struct("id", "at")
    met_by = materialise(met.where("h1_2 IS NOT NULL").groupBy("h1", "h1_2").agg(F.max("differ").alias("differ")), "line-pairs")
    named = firsts.select("h1", "id", "at")
    pairs = met_by.join(named, "h1").join(other(named), "h1_2")
    here, there = place, F.struct(F.col("id_2").alias("id"), F.col("at_2").alias("at"))
    pairs = materialise(pairs.select("differ", F.greatest(here, there).alias("x"), F.least(here, there).alias("y")).where("x != y").select("differ", "x.id", "x.at", F.col("y.id").alias("id_2"), F.col("y.at").alias("at_2")), "line-pairs")
    # one earlier line near it is enough for a line to go: the one whose parities are most like its own comes first, the others only where that is not near
    best = pairs.groupBy("id", "at").agg(F.min_by(F.struct("id_2", "at_2"), F.struct("differ", "id_2", "at_2")).alias("x"))
    best = materialise(best.select("id", "at", "x.id_2", "x.at_2"), "line-pairs")
    found = materialise(compared(best, firsts), "near-lines")
    rest = materialise(pairs.drop("differ").join(found, ["id", "at"], "left_anti").join(best, ["id", "at", "id_2", "at_2"], "left_anti"), "line-pairs")
    found = materialise(found.unionByName(compared(rest, firsts)), "near-lines")
    hot = met.where("h1_2 IS NULL").select("key", "h1", *PROFILE).join(named, "h1").drop("h1")
    hot = materialise(hot, "hot-lines")
    if not hot.limit(1).count():
        return found

    place = F.struct("id", "at", *PROFILE)
    own, their = ({c: F.col(f"{c}{x}") for c in PROFILE} for x in ("", "_2"))
    match = may_match(own, their, edits, per_words)
    star = hot.join(found, ["id", "at"], "left_anti").join(hot.groupBy("key").agg(F.min(place).alias("x")).select("key", *(F.col(f"x.{c}").alias(f"{c}_2") for c in ("id", "at", *PROFILE))), "key")
    star = materialise(star.where(match).select("id", "at", "id_2", "at_2").distinct(), "line-pairs")
    found = materialise(found.unionByName(compared(star, described_lines(star))).distinct(), "near-lines")
    members = hot
    if per_words:
        # two words in common: the first that two lines share is in a hot bucket, the second follows it in both lines
        tokens = firsts.where(F.col("n") >= per_words - 1).join(hot.select("id", "at").distinct(), ["id", "at"], "left_semi")
        tokens = with_first_tokens(tokens.withColumn("codes", F.sort_array(word_codes(_words("line")))), _reach(F.col("n"), per_words, edits) + 2).select("id", "at", "tokens")
        odd = hot.where(F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1)
        refined = odd.join(tokens, ["id", "at"]).select("*", F.explode(length_bands(F.col("n"), per_words, edits)).alias("band"))
        keys = F.transform("tokens", lambda x: F.xxhash64(x, F.col("band")).bitwiseOR(F.lit(1).cast("long")))
        refined = once(refined, "i", F.array_position(keys, F.col("key")).cast("int")).where("i > 0")
        refined = refined.select("id", "at", *PROFILE, "key", F.explode(F.slice("tokens", F.col("i") + 1, F.size("tokens"))).alias("second"))
        refined = refined.select(F.xxhash64("key", "second").bitwiseOR(F.lit(1).cast("long")).alias("key"), "id", "at", *PROFILE)
        members = hot.where(F.col("key").bitwiseAND(F.lit(1).cast("long")) == 0).unionByName(refined)
    members = materialise(members, "hot-lines")
    open_ = members.join(found, ["id", "at"], "left_anti")
    before = (F.col("id_2") < F.col("id")) | ((F.col("id_2") == F.col("id")) & (F.col("at_2") < F.col("at")))
    rest = open_.join(other(members), "key").where(before & match).select("id", "at", "id_2", "at_2").distinct()
    rest = materialise(rest.join(star, ["id", "at", "id_2", "at_2"], "left_anti"), "line-pairs")
    return found.unionByName(compared(rest, described_lines(rest)))


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells documents apart and orders them: the id, with the digest of the text where ids repeat."""
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count():
        return F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.md5(as_text(text_col)).alias("digest")))
    return F.col(id_col)


def _lines(docs: DataFrame, key: Column, text_col: str, min_chars: int) -> DataFrame:
    """(id, at, line) of the lines that may go."""
    lines = docs.select(key.alias("id"), as_text(text_col).alias("text")).where("id IS NOT NULL")
    return lines.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.char_length("line") >= min_chars)


def blank(text: str) -> Column:
    """Whether a text is null, empty or nothing but white space, Unicode's included."""
    return as_text(text).rlike(r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]*$")


def find_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20, per_words: int = 0, exact_chars: int | None = None) -> DataFrame:
    """(id, gone): the numbers of the lines of each document that repeat an earlier line, for documents that have such lines.

    Where ids repeat, ``id`` is a pair of id and digest of the text.
    """
    return _repeated(docs, _key(docs, id_col, text_col), text_col, edits, min_chars, per_words, exact_chars)


def _repeated(docs: DataFrame, key: Column, text_col: str, edits: int, min_chars: int, per_words: int, exact_chars: int | None) -> DataFrame:
    if not 1 <= edits <= 15 or min_chars <= 2 * edits:
        raise ValueError("edits must be from 1 to 15, and min_chars more than twice that")
    if per_words and per_words < 8:
        raise ValueError("per_words must be 0 or at least 8")
    least = min_chars if exact_chars is None else min(exact_chars, min_chars)
    able = _lines(docs, key, text_col, least)
    if least < min_chars:
        able = able.where((F.char_length("line") >= min_chars) | ~blank("line"))
    hashed = materialise(able.select("id", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2")), "line-hashes")
    place = F.struct("id", "at")
    groups = hashed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = materialise(hashed.join(groups, ["h1", "h2"]).where(place != F.col("first")).select("id", "at"), "equal-lines")
    scratch = [hashed, again]
    lines, n = _lines(docs, key, text_col, min_chars), again.count()
    # equal lines share all their keys and are told apart by their hashes later on; a list that is small enough spares them the way there
    if (known := small_side(again, n)) is not again:
        lines = lines.join(known, ["id", "at"], "left_anti")
    gone = again.unionByName(near_lines(lines, edits, min_chars, per_words, scratch))
    gone = materialise(gone.groupBy("id").agg(F.array_sort(F.collect_set("at")).alias("gone")), "repeated-lines")
    release(*scratch)
    return gone


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20, report: bool = False, per_words: int = 0, exact_chars: int | None = None) -> DataFrame:
    """Documents without their repeated lines; ``report`` adds ``n_lines`` and ``n_gone`` (in place of columns of these names)."""
    key = _key(docs, id_col, text_col)
    gone = _repeated(docs, key, text_col, edits, min_chars, per_words, exact_chars)
    sized = gone.agg(F.count("*").alias("n"), F.sum(F.size("gone")).alias("m")).first()
    key_name, gone_key, gone_name = (fresh_name(docs, x) for x in ("key", "gone_key", "gone"))
    gone = small_side(gone.select(F.col("id").alias(gone_key), F.col("gone").alias(gone_name)), sized["n"], 8 + (sized["m"] or 0) // (sized["n"] or 1) // 2)
    joined = docs.withColumn(key_name, key).join(gone, F.col(key_name) == F.col(gone_key), "left")
    lines = F.split(as_text(text_col), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone_name, i)), "\n")
    text = F.when(F.col(gone_name).isNull(), F.col(text_col)).otherwise(left)
    added = {"n_lines": F.size(lines).cast("long"), "n_gone": F.when(F.col(gone_name).isNull(), 0).otherwise(F.size(gone_name)).cast("long")} if report else {}
    return joined.withColumns({text_col: text, **added}).drop(key_name, gone_key, gone_name)

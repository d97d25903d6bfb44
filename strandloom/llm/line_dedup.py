"""Line dedup: one occurrence of each group of equal or similar lines is kept; DataFrame operations only.

A line's words are what ASCII marks and white space leave of it in lower case; a 64-bit hash of its words names it. Two
lines are alike if their edit distance, in words, is at most 1 - similarity of the longer line. Connected lines are a group,
and its first occurrence (by document, then line) stays.

Blocks. By the pigeonhole principle k edits leave k + 1 runs of a line untouched, so lines that are alike share runs of
words. A line of up to twice as many words as admit one edit has its first and its last RUN + 1 words as blocks: one edit leaves one of them
as it is, so no pair is lost. A longer line has blocks of RUN words that begin at its ANCHORS words of the least hashes; what
is chosen depends on the words alone, not on their places. An edit changes at most RUN blocks, and all chosen ones must be hit for a
pair to be lost: the README gives the measured share. SimHash blocks lose two thirds of such pairs (see there).

Blocks shared by up to SMALL lines give all their pairs of fitting lengths. In a larger one, LEADERS of its lines meet all of them first;
the links so far connect most lines of a family of copies. Lines of one group need not meet any more, so what is left are the
lines outside the block's main group, each with the lines of other groups. For these, blocks are cut by words: each line joins the block
with each of its rarest words, one more than edits can take from it, so that alike lines of the block meet again (see _rarest). A pair
that shares several cut blocks is made in the first of them only. Groups are those that all pairs of a block would give; no line is left out.

Before lines are compared, their parities are: 128 bits, each telling whether an odd number of a line's words falls in its slot. An edit
changes two words at most, so lines that are alike differ in no more bits than twice their edits, and other pairs are never made into rows.

Lines without words are never dropped. A document that loses all its other lines goes; all else keeps its columns. Nulls:
a null text passes through; null ids come last in order, by their texts. Rows with one id and one text are one document, whose rows are
treated alike; rows with one id and different texts are documents of their own, ordered by a hash of the text. Empty tables give
empty results; texts of any length are taken whole. Hot lines are counted before they are shuffled, or joined as plain tables, whose hot keys Spark splits.
Columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, marked_in, perhaps_in, written
from .components import components

#: Lines of a small block, leaders of a large one, words of a run, runs of a line, bits of a place within a line.
SMALL, LEADERS, RUN, ANCHORS, PLACES = 64, 8, 4, 5, 24
#: Rare words up to which a row of a cut block has them all, to tell whether a pair meets in another one, too.
MANY = 64
#: Slots of words whose counts tell which are rare.
SLOTS = 1 << 16
#: Edits up to which distances are tried first, as a band's cost grows with it.
FEW = 4
LAST = (1 << 63) - 1
PARITY = ("odd_0", "odd_1")
#: Keys of a line's blocks: of its two ends, and of its runs.
BLOCKS = ("end_0", "end_1", *(f"run_{i}" for i in range(ANCHORS)))


#: ASCII marks and white space but the line end and the space, one by one: Java looks single characters up in a table, and tries ranges in turn.
_MARKS = "[" + "".join(f"\\x{c:02x}" for c in (9, *range(11, 14), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))) + "]+"


def _plain(text: Column) -> Column:
    """A text in lower case, with a space for ASCII marks and for white space but the line end."""
    return F.regexp_replace(F.lower(text), _MARKS, " ")


def _words(plain: Column) -> Column:
    return F.array_remove(F.split(plain, " "), "")


def _doc(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def _text_key(text: str) -> Column:
    """31 bits that tell texts of one id apart."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1))


_BASE = 1 << 31


def _place(doc: str, key: str, line: str) -> Column:
    """Order of occurrence (document, text, line) as one number, which hash aggregation can take the least of."""
    within = F.col(key) * F.lit(_BASE) + F.col(line)
    return F.col(doc).cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + within.cast("decimal(19,0)")


def _anchors(words: str) -> Column:
    """The places of the words of the least hashes, in the low bits of the hashes."""
    low = (1 << PLACES) - 1
    hashed = F.transform(F.col(words), lambda w, i: F.xxhash64(w).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(low))))
    return F.slice(F.sort_array(hashed), F.lit(1), F.lit(ANCHORS))


def _start(n: str, anchors: str, i: int) -> Column:
    """The place where the run of an anchor begins, of the first one if there are not so many."""
    at = F.coalesce(F.get(anchors, F.lit(i)), F.get(anchors, F.lit(0))).bitwiseAND(F.lit((1 << PLACES) - 1))
    # a run that would go beyond the end is the line's last one
    return F.greatest(F.lit(0), F.least(at, F.col(n) - RUN)).cast("int")


def _least(edits: int, similarity: float) -> int:
    """The fewest words of a line between which and an alike one there can be so many edits, and that is the longer."""
    return next((n for n in range(1, 1 << 16) if int(n * (1 - similarity) + 1e-9) >= edits), 1 << 30)


def _blocks(d: DataFrame, similarity: float) -> DataFrame:
    """d (words, n and others) with keys of a line's blocks in columns BLOCKS, which hash aggregation can carry as it can't carry arrays; all null for lines that are alike only if equal.

    The steps are projections of their own, so that anchors and starts are computed once and no compiled method is too long for Java to compile further.
    """
    one, two = _least(1, similarity), _least(2, similarity)
    half, n = max(1, one // 2), F.col("n")
    anchors, *starts = (free_name(d, x) for x in ("anchors", *(f"start_{i}" for i in range(ANCHORS))))
    end = lambda start, tag: F.when((n >= one - 1) & (n < two), F.xxhash64(F.lit(tag), F.slice(F.col("words"), start, F.lit(half))))
    ends = end(F.lit(1), 1), end(F.greatest(n - (half - 1), F.lit(1)), 2)
    d = d.withColumns({**dict(zip(BLOCKS, ends)), anchors: F.when((n > 0) & (n >= max(one - 1, two - 2)), _anchors("words"))})
    d = d.withColumns({x: _start("n", anchors, i) for i, x in enumerate(starts)})
    # word by word, which gives the same as a hash of an array
    runs = (F.xxhash64(*(F.get("words", F.col(x) + j) for j in range(RUN))) for x in starts)
    return d.withColumns({b: F.when(F.col(anchors).isNotNull(), r) for b, r in zip(BLOCKS[2:], runs)}).drop(anchors, *starts)


def lines(docs: DataFrame, similarity: float) -> DataFrame:
    """(place, line_id, n, BLOCKS, line) of every line: n counts words, line is the plain line; line_id is null where a line has no words."""
    d = docs.where(F.col("text").isNotNull()).select(_doc("doc_id").alias("doc"), _text_key("text").alias("text_key"), F.posexplode(F.split(_plain(F.col("text")), "\n", -1)).alias("line_no", "line"))
    d = d.select(_place("doc", "text_key", "line_no").alias("place"), "line", _words(F.col("line")).alias("words"))
    d = d.select("place", "line", "words", F.size("words").alias("n"))
    d = _blocks(d.withColumn("line_id", F.when(F.col("n") > 0, F.xxhash64("words"))), similarity)
    return written(d.select("place", "line_id", "n", *BLOCKS, "line"), "lines", dictionary=False)


def _codes(words: Column) -> Column:
    """A number of 20 bits for each word."""
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(0xF0000)).cast("int") + 0x10000)


def _string(codes: Column) -> Column:
    """One character for each number, of five hexadecimal digits, by way of eight."""
    return F.when(F.size(codes) > 0, F.decode(F.unhex(F.concat(F.lit("000"), F.array_join(F.transform(codes, F.hex), "000"))), "UTF-32")).otherwise("")


def _coded(words: Column) -> Column:
    """A line's words as a string with one character of 20 bits for each, so that edit distance counts words."""
    return _string(_codes(words))


def _parities(d: DataFrame) -> DataFrame:
    """d with PARITY: for each of 128 slots, whether an odd number of words (column codes) falls in it. A shift takes the low six bits of a code, the seventh tells the half."""
    odd = lambda bit: F.aggregate("codes", F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(F.call_function("shiftleft", bit(c), c)))
    d = d.withColumns({PARITY[0]: odd(lambda c: F.lit(1).cast("long")), PARITY[1]: odd(lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(1)).cast("long"))})
    return d.withColumn(PARITY[0], F.col(PARITY[0]).bitwiseXOR(F.col(PARITY[1])))


def _most(a: str, b: str, similarity: float) -> Column:
    """The most edits between two alike lines of so many words."""
    return F.floor(F.greatest(a, b) * F.lit(1 - similarity) + 1e-9).cast("int")


def _fit(similarity: float) -> Column:
    """Whether lengths and parities admit that two lines are alike."""
    most = _most("a_n", "b_n", similarity)
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in PARITY), F.lit(0))
    return (F.abs(F.col("a_n") - F.col("b_n")) <= most) & (differ <= 2 * most)


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select("key", F.col("line_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", *PARITY)))


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) of line ids, a written table, whose lines are alike."""
    asked = lambda x: perhaps_in(texts, F.col("line_id"), pairs.select(F.col(x).alias("h")))
    side = lambda x: asked(x).select(F.col("line_id").alias(x), F.col("coded").alias(f"{x}_coded"), F.col("n").alias(f"{x}_n"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_coded", "b_coded", _most("a_n", "b_n", similarity).alias("most"))
    few = F.expr(f"levenshtein(a_coded, b_coded, least(most, {FEW})) >= 0")
    return both.where(F.when(few, True).otherwise(F.expr("levenshtein(a_coded, b_coded, most) >= 0"))).select("a", "b")


def _several(rows: DataFrame) -> DataFrame:
    """(key, m) of blocks that several lines share, with their number."""
    return rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs of lines of fitting lengths in small blocks."""
    small = rows.where(F.col("m") <= SMALL)
    return _side(small, "a").join(_side(small, "b"), "key").where((F.col("a") < F.col("b")) & _fit(similarity)).select("a", "b").distinct()


def groups(table: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of ids of like lines. known: (line_id, place, n, BLOCKS) of each distinct line's first occurrence in the table of lines."""
    keyed = known.select(F.explode(F.array_distinct(F.array(*BLOCKS))).alias("key"), "line_id", "n", "place").where("key is not null")
    several = written(_several(keyed), "counts")
    shared = written(perhaps_in(keyed, F.col("key"), several.select(F.col("key").alias("h"))).join(several, "key"), "blocks")
    needed = written(shared.select("line_id", "place", "n").distinct(), "needed")
    at = lambda: F.xxhash64("line_id", "place")
    texts = perhaps_in(table.select("line_id", "place", "line"), at(), needed.select(at().alias("h"))).join(needed, ["line_id", "place"])
    # rows of one id and one text are one document, whose lines are here more than once; a line has one place here, and rows are dealt by both
    texts = texts.dropDuplicates(["line_id", "place"]).select("line_id", "n", _codes(_words(F.col("line"))).alias("codes"))
    texts = written(_parities(texts).select("line_id", "n", _string(F.col("codes")).alias("coded"), *PARITY), "coded")
    rows = written(shared.drop("place").join(texts.select("line_id", *PARITY), "line_id"), "rows")
    forget(needed, several, shared)
    pairs, large = written(_pairs(rows, similarity), "pairs"), rows.where(F.col("m") > SMALL).drop("m")
    found = written(_alike(pairs, texts, similarity), "like")
    out = written(components(found) if large.isEmpty() else _large(large, texts, found, similarity), "groups")
    forget(pairs, rows, texts, found)
    return out


def _led(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links of LEADERS lines of each block with all its lines."""
    lead = rows.groupBy("key", F.pmod("line_id", F.lit(LEADERS)).alias("of")).agg(F.min(F.struct("line_id", "n", *PARITY)).alias("o"))
    lead = _side(lead.select("key", "o.*"), "a")
    met = lead.join(_side(rows, "b"), "key").where((F.col("a") != F.col("b")) & _fit(similarity))
    pairs = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    out = written(_alike(pairs, texts, similarity), "led")
    forget(pairs)
    return out


def _rarity(words: DataFrame) -> bytes:
    """A byte for each slot of words (ids `words` of distinct words of each line): in how many lines its words are, by quarters of a power of two."""
    counts = words.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(SLOTS - 1)).alias("id")).agg(F.count("*").alias("c"))
    byte = F.char((F.least(F.lit(120), F.floor(F.log2(F.coalesce("c", F.lit(0)) + 1) * 4)) + 1).cast("long"))
    all_slots = words.sparkSession.range(SLOTS).join(counts, "id", "left").select(F.struct("id", byte.alias("b")).alias("s"))
    return all_slots.agg(F.array_join(F.sort_array(F.collect_list("s"))["b"], "").alias("all")).first()["all"].encode()  # SLOTS bytes at every size


def _rarest(lines: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(line_id, w, ws) of each line's rarest words w: one more than edits can take from it, so that alike lines share one of them or have no word in common.

    Any order of words that is the same for all lines will do; here words go by their slots' counts, which is a table of fixed size.
    ws has them all, or is null if they are more than MANY, so that a line's rows stay in proportion to its length.
    """
    asked = perhaps_in(texts, F.col("line_id"), lines.select(F.col("line_id").alias("h")))
    words = written(asked.join(lines, "line_id").select("line_id", "n", F.array_distinct(F.transform(F.split("coded", ""), lambda w: F.ascii(w))).alias("words")), "words")
    table = F.lit(_rarity(words))
    rank = lambda w: F.ascii(F.substring(table, w.bitwiseAND(F.lit(SLOTS - 1)) + 1, F.lit(1)).cast("string"))
    edits = F.floor(F.col("n") * F.lit((1 - similarity) / similarity) + 1e-6).cast("int")
    first = F.slice(F.sort_array(F.transform("words", lambda w: rank(w).cast("long") * (1 << 20) + w)), F.lit(1), edits + 1)
    ws = words.select("line_id", F.transform(first, lambda x: x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")).alias("ws"))
    out = written(ws.select("line_id", F.explode("ws").alias("w"), F.when(F.size("ws") <= MANY, F.col("ws")).alias("ws")), "rarest")
    forget(words)
    return out


def _apart(rows: DataFrame, group: DataFrame) -> DataFrame:
    """(key, line_id, n, parities, of, open) of the blocks whose lines aren't all of one group: `of` names a line's group, open lines are outside their block's main one."""
    of = rows.join(group.select(F.col("node").alias("line_id"), "component"), "line_id", "left").withColumn("of", F.coalesce("component", "line_id")).drop("component")
    of = written(of, "of")
    main = of.groupBy("key", "of").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "of"))["of"].alias("main"), F.count("*").alias("groups"))
    out = written(of.join(main.where("groups > 1"), "key").select("key", "line_id", "n", *PARITY, "of", (F.col("of") != F.col("main")).alias("open")), "apart")
    forget(of)
    return out


def _large(rows: DataFrame, texts: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Groups (node, component) of what found and the large blocks (key, line_id, n, parities) connect."""
    led = _led(rows, texts, similarity)
    group = written(components(found.union(led)), "led-groups")
    apart = _apart(rows, group)
    keys = apart.groupBy("line_id").agg(F.sort_array(F.collect_set("key")).alias("ks")).select("line_id", F.when(F.size("ks") > 1, F.col("ks")).alias("ks"))
    cut = written(apart.join(_rarest(keys.select("line_id"), texts, similarity), "line_id").join(keys, "line_id"), "cut")
    side = lambda x: cut.select("key", "w", F.col("line_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", *PARITY, "of", "open", "ws", "ks")))
    once = F.expr("coalesce(array_min(array_intersect(a_ks, b_ks)) = key, true) and coalesce(array_min(array_intersect(a_ws, b_ws)) = w, true)")
    meet = F.expr("a_of <> b_of and (not b_open or a < b)") & _fit(similarity) & once
    pairs = side("a").where("a_open").join(side("b"), ["key", "w"]).where(meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.distinct(), "pairs")
    more = written(_alike(pairs, texts, similarity), "like")
    forget(led, apart, cut, pairs)
    return _joined(group, more)


def _joined(group: DataFrame, more: DataFrame) -> DataFrame:
    """Groups (node, component), with those that more links (a, b) connect as one: only whole groups are linked anew."""
    of = lambda x: group.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of"))
    linked = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    whole = written(components(linked), "whole").select(F.col("node").alias("of"), F.col("component").alias("whole"))
    old = group.join(whole, group["component"] == whole["of"], "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = whole.join(group, whole["of"] == group["component"], "left_anti").select("of", "whole")
    return old.union(new)


def dropped(docs: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(doc, text_key, flags): for every document that loses a line, a byte for each line up to the last that goes, 1 if it goes."""
    table = lines(docs, similarity)
    known = table.where("line_id is not null").groupBy("line_id").agg(F.min("place").alias("place"), F.count("*").alias("c"), *(F.first(c).alias(c) for c in ("n", *BLOCKS)))
    known = written(known, "distinct")
    group = groups(table, known, similarity)
    grouped = group.join(known.select("line_id", "place"), group["node"] == F.col("line_id")).select("component", "line_id", "place")
    kept = written(grouped.groupBy("component").agg(F.min("place").alias("kept")), "kept")
    alone = known.where("c > 1").join(group, F.col("line_id") == group["node"], "left_anti").select("line_id", F.col("place").alias("kept"))
    rule = written(grouped.join(kept, "component").select("line_id", "kept").union(alone), "rules")
    repeated = perhaps_in(table.select("line_id", "place"), F.col("line_id"), rule.select(F.col("line_id").alias("h")))
    gone = repeated.join(rule, "line_id").where("place <> kept").select("place")
    base = F.lit(1 << 62).cast("decimal(19,0)")
    within = F.pmod("place", base)
    gone = gone.select(((F.col("place") - within) / base).cast("long").alias("doc"), within.cast("long").alias("within"))
    gone = gone.select("doc", F.shiftright("within", 31).alias("text_key"), F.col("within").bitwiseAND(F.lit(_BASE - 1)).cast("int").alias("line_no"))
    gone = gone.groupBy("doc", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("goes"))
    before = F.concat(F.array(F.lit(-1)), F.slice("goes", F.lit(1), F.size("goes") - 1))
    flags = F.zip_with("goes", before, lambda g, b: F.concat(F.repeat(F.lit("0"), g - b - 1), F.lit("1")))
    out = written(gone.select("doc", "text_key", F.array_join(flags, "").cast("binary").alias("flags")), "gone")
    forget(table, known, group, kept, rule)
    return out


def dedup_lines(docs: DataFrame, similarity: float = 0.9) -> DataFrame:
    """docs with repeated lines taken out of `text`; documents of which nothing but blank lines is left go."""
    if not 0.5 < similarity <= 1:
        raise ValueError("similarity must be over 0.5 and at most 1")
    doc, key, flags, left = (free_name(docs, x) for x in ("doc", "text_key", "flags", "left"))
    gone = dropped(docs.select("doc_id", "text"), similarity).select(F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("flags").alias(flags))
    # only documents that may lose a line are shuffled, by the same join at every size: what is sent grows with the input alone
    may = free_name(docs, "may")
    keyed = marked_in(docs.withColumns({doc: _doc("doc_id"), key: _text_key("text")}), F.xxhash64(doc, key), gone.select(F.xxhash64(doc, key).alias("h")), may)
    rest = keyed.where(~F.col(may)).select(*(F.col(f"`{c}`") for c in docs.columns))
    # flags are a byte a line and unique, so they are what a task holds, and texts are not sorted
    both = keyed.where(may).join(gone.hint("shuffle_hash"), [doc, key], "left")
    keeps = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: F.substring(F.col(flags), i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    both = both.withColumn(left, F.when(F.col(flags).isNull(), F.col("text")).otherwise(keeps))
    words = F.col(left).rlike(r"[^\x09-\x0d\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]")
    both = both.where(F.col(flags).isNull() | words)
    return rest.union(both.select(*(F.col(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns)))

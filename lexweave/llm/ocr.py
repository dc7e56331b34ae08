"""Problem 7: noise in text from scanned pages.

Everything runs in SQL. Words of all blocks are counted; each word has an anagram hash (the sum of the fifth powers of its
characters' codes), so a misreading such as m -> rn shifts the hash by a fixed difference, wherever in the word it happens. Rare
words of scanned pages are joined with frequent words whose hash lies one or two such differences away; the replacement is then
checked letter by letter and the variants are ranked (most frequent, then fewest misreadings, then by spelling).

Words hyphenated across lines are joined unless the hyphenated form is the better attested one. The first line of a page is
a running header if its letters recur (nearly) as first line of other pages of the document or begin with the app's name;
page numbers are recognised on the last line.

Cases: blocks of pages that aren't scanned come out unchanged; null and empty texts too; repeated rows count once; a word without a
sufficiently frequent variant stays as it is.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.keys import name_key, reject_missing
from lexweave.session import materialize

# What scanning makes of letters (read as, meant).
CONFUSIONS = (
    ("0", "o"), ("1", "i"), ("1", "l"), ("11", "ll"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("!", "i"), ("!", "l"), ("|", "l"),
    ("c", "e"), ("f", "t"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("e", "c"), ("t", "f"), ("m", "rn"), ("q", "g"),
)
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
HYPHENS = "\\-‐¬\u00ad"
PAGE_LINE = (
    r"(?i)\A[^\p{L}\p{N}]*(?:(?:p|pg|[pf]\s*a\s*[gq9]\s*[ec])[.:]?\s*)?[0-9lIOoi!]{1,4}(?:\s*(?:[o0]f|[o0]t|/)\s*[0-9lIOoi!]{1,4})?[^\p{L}\p{N}.]*\z"
)
LETTERS_RATIO, SIGNS_RATIO, LEAST = 5, 2, 4


def _power(code: int) -> int:
    return (code % 1000) ** 5


def anagram_hash(word: Column) -> Column:
    def step(acc, ch):
        x = F.pmod(F.ascii(ch), F.lit(1000)).cast("bigint")
        return acc + x * x * x * x * x

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), step)


def _delta(pair: tuple[str, str]) -> int:
    return sum(_power(ord(c)) for c in pair[1]) - sum(_power(ord(c)) for c in pair[0])


def _unligature(c: Column) -> Column:
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def core(token: Column) -> Column:
    """The token in lower case without punctuation at its ends; ! next to a letter stays, for it may be a misread i."""
    t = F.regexp_replace(token, r"^[^\p{L}\p{N}!]+|[^\p{L}\p{N}!]+$", "")
    return F.lower(F.regexp_replace(t, r"^!+(?![\p{L}])|(?<![\p{L}])!+$", ""))


def blocks_of(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """(clause_id, doc, page, app_key, text, scanned), one row for each clause_id; written to the shared folder."""
    reject_missing(raw, "clause_id", "source_file", "page_start", "app_name", "clause_text")
    reject_missing(pages, "doc", "page_number", "needs_ocr")
    one = raw.groupBy("clause_id").agg(F.min(F.struct("clause_text", "source_file", "page_start", "app_name")).alias("r"))
    one = one.select(
        "clause_id",
        F.col("r.source_file").alias("doc"),
        F.col("r.page_start").alias("page"),
        F.coalesce(name_key(F.col("r.app_name")), F.lit("")).alias("app_key"),
        F.col("r.clause_text").alias("text"),
    ).where("clause_id is not null")
    scanned = pages.where("needs_ocr").select("doc", F.col("page_number").alias("page")).distinct().withColumn("scanned", F.lit(True))
    return materialize(one.join(scanned, ["doc", "page"], "left").withColumn("scanned", F.coalesce("scanned", F.lit(False))), "blocks")


def lines_of(blocks: DataFrame) -> DataFrame:
    """Lines with what stands before and after them; `first` and `last` mark the outermost lines that aren't blank."""
    arr = F.split("text", "\n", -1)
    full = F.transform(F.filter(F.transform(arr, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.trim(s["x"]) != ""), lambda s: s["i"])
    at = blocks.where("text is not null").withColumn("arr", arr).withColumn("full", full)
    at = at.select("clause_id", "doc", "page", "app_key", "scanned", "arr", F.array_min("full").alias("lo"), F.array_max("full").alias("hi"), F.posexplode("arr").alias("line_no", "line"))
    cut = rf"[\p{{L}}\p{{N}}][{HYPHENS}]\s*$"
    nxt, prv = F.get("arr", F.col("line_no") + 1), F.get("arr", F.col("line_no") - 1)
    goes_on = r"^\s*[\p{L}\p{N}!]"
    return at.select(
        "clause_id", "doc", "page", "app_key", "scanned", "line_no", "line",
        (F.col("line_no") == F.col("lo")).alias("first"),
        (F.col("line_no") == F.col("hi")).alias("last"),
        (F.col("scanned") & F.col("line").rlike(cut) & F.coalesce(nxt.rlike(goes_on), F.lit(False))).alias("cut"),
        (F.col("scanned") & F.coalesce(prv.rlike(cut), F.lit(False)) & F.col("line").rlike(goes_on)).alias("tail"),
        F.when(F.col("scanned") & F.col("line").rlike(cut), F.regexp_extract(nxt, r"^\s*(\S+)", 1)).alias("next_token"),
    )


def furniture(lines: DataFrame, min_pages: int = 2) -> DataFrame:
    """(clause_id, line_no, kind) of running headers and page numbers of scanned blocks. A document may have any number of running
    headers (left and right pages, one for each chapter): a first line is one if its letters are nearly those of a first line that stands on
    min_pages pages of the document."""
    edge = lines.where("scanned and (first or last)")
    number = edge.where(F.col("last") & F.col("line").rlike(PAGE_LINE)).select("clause_id", "line_no", F.lit("number").alias("kind"))
    heads = edge.where(F.col("first") & ~F.col("line").rlike(PAGE_LINE)).select(
        "clause_id", "doc", "page", "app_key", "line_no", F.regexp_replace(F.lower(_unligature(F.col("line"))), "[^a-z]+", "").alias("key")
    )
    seen = heads.where("key <> ''").groupBy("doc", "key").agg(F.count_distinct("page").alias("n"))
    often = seen.where(F.col("n") >= min_pages).select("doc", F.col("key").alias("best"))
    # distinct first lines are matched with the recurring ones of their document, not every page's line
    near = F.levenshtein("key", "best") * 8 <= F.length("best")
    alike = seen.select("doc", "key").join(often, "doc").where(near).select("doc", "key").distinct().withColumn("recurs", F.lit(True))
    app = F.regexp_replace("app_key", "[^a-z]+", "")
    named = (F.length(app) >= 4) & (F.levenshtein(F.expr("left(key, length(regexp_replace(app_key, '[^a-z]+', '')))"), app) <= F.when(F.length(app) >= 8, 1).otherwise(0))
    named = named & ~F.trim(F.col("key")).eqNullSafe("")
    header = heads.join(alike, ["doc", "key"], "left").where(F.coalesce("recurs", F.lit(False)) | F.coalesce(named, F.lit(False)))
    return number.unionByName(header.select("clause_id", "line_no", F.lit("header").alias("kind")))


def tokens_of(lines: DataFrame) -> DataFrame:
    """(clause_id, scanned, line_no, tok_no, token, role): role is 'word', 'head' (cut at the line's end) or 'tail'."""
    toks = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    at = lines.select("clause_id", "scanned", "line_no", "cut", "tail", "next_token", F.size(toks).alias("n"), F.posexplode(toks).alias("tok_no", "token"))
    role = F.when(F.col("cut") & (F.col("tok_no") == F.col("n") - 1), "head").when(F.col("tail") & (F.col("tok_no") == 0), "tail").otherwise("word")
    return at.select("clause_id", "scanned", "line_no", "tok_no", "token", "next_token", role.alias("role"))


def word_counts(tokens: DataFrame) -> DataFrame:
    """(word, n, n_low): how often each word stands whole in all blocks, and how often with a small first letter."""
    # written out, so that the filter on words below isn't pushed to every token: punctuation is cut off distinct tokens only
    each = materialize(tokens.where("role = 'word'").groupBy("token").agg(F.count("*").alias("n")), "each")
    low = F.col("token").rlike(r"^[^\p{L}\p{N}]*[\p{Ll}0-9]")
    each = each.select(core(F.col("token")).alias("word"), "n", F.when(low, F.col("n")).otherwise(0).alias("n_low"))
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_low").alias("n_low")).where("word <> ''")


def corrections(suspects: DataFrame, counts: DataFrame) -> DataFrame:
    """suspects(word) -> (word, right, n_right): the best variant of each word that has one."""
    one = [("", "", "", "", 0, 0)] + [(a, "", b, "", _delta((a, b)), 1) for a, b in CONFUSIONS]  # the first: a ligature and nothing else
    two = [(p[0], q[0], p[1], q[1], _delta(p) + _delta(q), 2) for p, q in combinations_with_replacement(CONFUSIONS, 2) if p[0] != q[1] and q[0] != p[1]]
    table = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(x, ("string", "string", "string", "string", "bigint", "int"), ("f1", "f2", "t1", "t2", "d", "cost"))]) for x in one + two])
    own = suspects.join(counts.select("word", F.col("n").alias("n_own")), "word", "left").select("word", F.coalesce("n_own", F.lit(0)).alias("n_own"))
    own = own.withColumn("plain", _unligature(F.col("word"))).where(F.col("plain").rlike(r"[\p{L}]"))
    tried = own.select("word", "plain", "n_own", anagram_hash(F.col("plain")).alias("h"), F.explode(F.filter(table, lambda t: F.contains(F.col("plain"), t["f1"]) & F.contains(F.col("plain"), t["f2"]))).alias("t"))
    good = counts.where((F.col("n") >= 2) & F.col("word").rlike(r"\A[a-z]+(?:[-'’][a-z]+)*\z")).select(F.col("word").alias("right"), F.col("n").alias("n_right"), "n_low", anagram_hash(F.col("word")).alias("hr"))
    met = tried.withColumn("hr", F.col("h") + F.col("t.d")).join(good, "hr")

    def swapped(text: Column, f: Column, t: Column, then) -> Column:
        return F.exists(F.sequence(F.lit(1), F.length(text)), lambda i: (F.substring(text, i, F.length(f)) == f) & then(F.concat(F.substring(text, F.lit(1), i - 1), t, F.substring(text, i + F.length(f), F.length(text)))))

    right = F.col("right")
    once = swapped(F.col("plain"), F.col("t.f1"), F.col("t.t1"), lambda x: x == right)
    twice = swapped(F.col("plain"), F.col("t.f1"), F.col("t.t1"), lambda x: swapped(x, F.col("t.f2"), F.col("t.t2"), lambda y: y == right))
    signs = F.col("word").rlike(r"[0-9!|]") | (F.col("word") != F.col("plain"))
    enough = F.when(signs, F.col("n_right") >= SIGNS_RATIO * F.col("n_own")).otherwise(
        (F.col("n_right") >= LETTERS_RATIO * F.col("n_own")) & (F.col("n_right") >= LEAST) & (F.col("n_low") * 3 >= F.col("n_right"))
    )
    written_out = (F.col("word") != F.col("plain")) & (F.col("plain") == right)
    fits = met.where(enough & F.when(F.col("t.cost") == 0, written_out).when(F.col("t.cost") == 1, once).otherwise(twice))
    rank = F.struct(F.col("n_right"), -F.col("t.cost"), F.col("right"))
    best = fits.groupBy("word").agg(F.max(rank).alias("b")).select("word", F.col("b.right").alias("right"), F.col("b.n_right").alias("n_right"))
    # a ligature is damage in itself: without another variant the word is written out
    plain = own.where("word <> plain").select("word", F.col("plain").alias("right"), F.lit(1).cast("bigint").alias("n_right"))
    return best.unionByName(plain.join(best, "word", "left_anti"))


class Repair:
    """Everything found out about the blocks of one pair of tables; found() and paragraphs() read it. Headers of more than one line
    and footers stay, and page numbers are looked for on the last line only."""

    def __init__(self, raw: DataFrame, pages: DataFrame):
        self.blocks = blocks_of(raw, pages)
        lines = lines_of(self.blocks)
        self.lines = lines.where("scanned")
        self.out = materialize(furniture(lines), "furniture")
        self.counts = materialize(word_counts(tokens_of(lines)), "counts")
        body = self.lines.join(self.out.select("clause_id", "line_no"), ["clause_id", "line_no"], "left_anti")
        self.tokens = materialize(tokens_of(body).drop("scanned"), "tokens")
        # words are worked out for distinct tokens and for words cut at a line's end, not for every token of every page
        kinds = materialize(self.tokens.where("role <> 'tail'").select("role", "token", F.when(F.col("role") == "head", F.col("next_token")).alias("next_token")).distinct(), "kinds")
        self.words = kinds.where("role = 'word'").select("token", core(F.col("token")).alias("word"))
        head = F.regexp_replace("token", rf"[{HYPHENS}]+$", "")
        self.heads = kinds.where("role = 'head'").select(
            "token", "next_token",
            core(F.concat(head, F.col("next_token"))).alias("word"),
            core(F.concat(head, F.lit("-"), F.col("next_token"))).alias("apart"),
            core(head).alias("left"),
            core(F.col("next_token")).alias("right_part"),
        )
        suspects = self.words.select("word").union(self.heads.select("word")).where("word <> ''").distinct()
        self.fixes = materialize(corrections(suspects, self.counts), "fixes")

    def judged(self) -> DataFrame:
        """tokens with `repaired`: null where nothing is wrong, else the word as it should be."""
        n = lambda c, name: self.counts.select(F.col("word").alias(c), F.col("n").alias(name))
        heads = (
            self.heads
            .join(n("word", "n_word"), "word", "left").join(n("apart", "n_apart"), "apart", "left")
            .join(n("left", "n_left"), "left", "left").join(n("right_part", "n_right_part"), "right_part", "left")
            .join(self.fixes.withColumnRenamed("right", "fixed"), "word", "left")
        )
        zero = lambda c: F.coalesce(c, F.lit(0))
        joined = F.greatest(zero("n_word"), zero("n_right"))
        compound = (zero("n_apart") > joined) | ((joined == 0) & (zero("n_left") >= LEAST) & (zero("n_right_part") >= LEAST))
        heads = heads.select("token", "next_token", F.when(~compound, F.coalesce("fixed", "word")).alias("repaired"))
        fixed = self.words.join(self.fixes.select("word", F.col("right").alias("repaired")), "word").select("token", "repaired")
        word = self.tokens.where("role = 'word'").join(fixed, "token", "left")
        cut = self.tokens.where("role = 'head'").join(heads, ["token", "next_token"], "left")
        cols = ["clause_id", "line_no", "tok_no", "token", "next_token", "role", "repaired"]
        return word.select(*cols).unionByName(cut.select(*cols))

    def found(self) -> DataFrame:
        """(clause_id, line_no, found_text): repaired words, and '' for headers and page numbers."""
        words = self.judged().where("repaired is not null").select("clause_id", "line_no", F.regexp_replace("repaired", "[!|]+", "").alias("found_text"))
        return words.union(self.out.select("clause_id", "line_no", F.lit("").alias("found_text"))).distinct()

    def paragraphs(self) -> DataFrame:
        """(clause_id, clean_text): scanned blocks as paragraphs, divided by blank lines of the page."""
        j = self.judged()
        edge = r"^([^\p{L}\p{N}!]*)(.*?)([^\p{L}\p{N}!]*)$"
        source = F.when(F.col("role") == "head", F.col("next_token")).otherwise(F.col("token"))
        upper = F.col("token").rlike(r"^[^\p{L}]*\p{Lu}")
        caps = F.col("token").rlike(r"\p{Lu}{2}") & ~F.col("token").rlike(r"\p{Ll}")
        word = F.when(caps, F.upper("repaired")).when(upper, F.concat(F.upper(F.expr("left(repaired, 1)")), F.expr("substr(repaired, 2)"))).otherwise(F.col("repaired"))
        fixed = F.concat(F.regexp_extract("token", edge, 1), word, F.regexp_extract(source, edge, 3))
        compound = F.concat(F.regexp_replace("token", rf"[{HYPHENS}]+$", "-"), F.col("next_token"))
        text = F.when(F.col("repaired").isNotNull(), fixed).when(F.col("role") == "head", compound).otherwise(F.col("token"))
        toks = j.where("role <> 'tail'").select("clause_id", "line_no", "tok_no", text.alias("t"))
        blank = self.lines.where(F.trim("line") == "").select("clause_id", "line_no", F.lit(0).alias("tok_no"), F.lit(None).cast("string").alias("t"))
        rows = toks.unionByName(blank).groupBy("clause_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "tok_no", "t"))).alias("r"))
        joined = F.array_join(F.transform("r", lambda x: F.coalesce(x["t"], F.lit("\n"))), " ")
        clean = F.trim(F.regexp_replace(F.regexp_replace(joined, r" *\n[ \n]*", "\n\n"), r"^\s+|\s+$", ""))
        return self.blocks.where("scanned").select("clause_id", "text").join(rows.select("clause_id", clean.alias("clean")), "clause_id", "left").select(
            "clause_id", F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.coalesce("clean", F.lit(""))).alias("clean_text")
        )



"""Repair of text that was recognised on scanned pages.

Line classifiers find running lines and page numbers at the edges of a page,
and decide for each pair of lines that ends in a hyphen whether the hyphen
belongs to the word. Words are corrected from the vocabulary of all pages:
candidates come from an inverted join on rare character q-grams, and
gradient-boosted trees choose the replacement.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.models import Logistic, bounded_sample
from caseloom.session import written

HYPHENS = "-­‐‑¬"
_LINE = re.compile(r"\r\n|\n|\r")
_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})"
_ALONE = re.compile(rf"^[\s\-–—|·\[(]*(?:page|pag\.?|p\.|pg\.?|página|seite)?\s*({_NUMBER})\s*(?:(?:of|/|de|von)\s*\d{{1,4}})?[\s\-–—|·\])]*$", re.I)
_AHEAD = re.compile(rf"^\s*({_NUMBER})(?:\s+[\-–—]\s+|\s{{2,}}|\t+|\s*[|·]\s*)(\S.*)$")
_BEHIND = re.compile(rf"^(.*\S)(?:\s+[\-–—]\s+|\s{{2,}}|\t+|\s*[|·]\s*)({_NUMBER})\s*$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_WORD_START, _WORD_END = re.compile(r"^[^\w@!]+|^[@!]+(?!\w)"), re.compile(r"[^\w@]+$")
_JOINED = re.compile(rf"(?:^|.*[^\W_])[{HYPHENS}]$")


def number_value(printed: str) -> int:
    """The value of an arabic or roman page number, -1 if it is none."""
    if printed.isdigit():
        return int(printed)
    digits = [_ROMAN[c] for c in printed.lower()]
    total = sum(-a if a < b else a for a, b in zip(digits, digits[1:] + [0]))
    return total if 0 < total < 200 else -1


def split_number(line: str) -> tuple[str, str]:
    """(line without its page number, printed page number), either may be empty."""
    if m := _ALONE.match(line):
        return "", m.group(1).lower()
    for pattern, number, rest in ((_BEHIND, 2, 1), (_AHEAD, 1, 2)):
        if m := pattern.match(line):
            return " ".join(m.group(rest).lower().split()), m.group(number).lower()
    return " ".join(line.lower().split()), ""


def word_of(token: str) -> str:
    """Lower case, without punctuation at the ends."""
    return _WORD_END.sub("", _WORD_START.sub("", token.lower()))


def text_lines(text: str) -> list[str]:
    return _LINE.split(text)


EDGE = 3
_LINE_FEATURES = ["outermost", "second", "lone", "repeats", "agreement", "stops", "small_start", "capitals", "shortness", "numbered", "spread", "alone_number", "has_number"]


def _edge_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, inside = [], Counter()
        for doc, page, text in zip(batch["doc_id"], batch["page_index"], batch["text"]):
            lines = text_lines(text)
            full = [i for i, x in enumerate(lines) if x.strip()]
            width = max((len(lines[i]) for i in full), default=1)
            for k, i in enumerate(full):
                depth = min(k, len(full) - 1 - k)
                line = lines[i].strip()
                if depth >= EDGE:
                    inside[" ".join(line.lower().split())] += 1
                    continue
                core, number = split_number(line)
                value = number_value(number) if number else -1
                letters = [c for c in line if c.isalpha()]
                rows.append((
                    doc, page, i, core, number, value - page if value >= 0 else None, 0, float(depth == 0), float(depth == 1),
                    float((i == 0 or not lines[i - 1].strip()) and (i + 1 >= len(lines) or not lines[i + 1].strip())),
                    float(line[-1] in ".;,:" + HYPHENS), float(line[0].islower() and not number), sum(c.isupper() for c in letters) / max(1, len(letters)),
                    1 - min(1.0, len(line) / width), float(bool(re.match(r"\d+(\.\d+)*\.? +[^\W\d]", line))), float(not core), float(bool(number)),
                ))
        names = ["doc_id", "page_index", "line_no", "core", "number", "offset", "inside", "outermost", "second", "lone", "stops", "small_start", "capitals", "shortness", "numbered", "alone_number", "has_number"]
        frame = pd.DataFrame(rows, columns=names)
        frame["offset"] = frame["offset"].astype("Int64")
        yield frame
        yield pd.DataFrame([(None, 0, 0, core, "", None, n, *[0.0] * 10) for core, n in inside.items()], columns=names).astype({"offset": "Int64"})


_EDGE_SCHEMA = (
    "doc_id string, page_index int, line_no int, core string, number string, offset bigint, inside bigint, outermost double, second double, lone double, stops double, "
    "small_start double, capitals double, shortness double, numbered double, alone_number double, has_number double"
)


def scanned_pages(hits: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, page_index, text)`` of hits with an excerpt and a page."""
    p = hits.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), F.col("text_excerpt").alias("text"))
    return p.where("doc_id is not null and page_index is not null and text is not null").distinct()


def page_furniture(pages: DataFrame, training_rows: int = 20_000) -> DataFrame:
    """``(doc_id, page_index, line_no, core, number)`` of running lines and page numbers.

    Lines among the outermost three at either edge are classified by their
    form, by how many pages of the document repeat the line, how often it
    stands further inside on any page, over how many documents
    it is spread, and by how many pages agree on the distance between printed
    and counted page number. The logistic model is fitted on at most
    ``training_rows`` lines whose label is beyond doubt.
    """
    lines = written(pages.mapInPandas(_edge_lines, _EDGE_SCHEMA), "scan-lines")
    edge = lines.where("inside = 0").drop("inside")
    same = edge.where("core <> ''").groupBy("doc_id", "core").agg(F.count_distinct("page_index").alias("same_pages"))
    spread = same.groupBy("core").agg(F.count("*").alias("docs"), F.sum("same_pages").alias("all_pages"))
    offsets = edge.where("offset is not null").groupBy("doc_id", "offset").agg(F.count_distinct("page_index").alias("agree"))
    interior = lines.where("inside > 0").groupBy("core").agg(F.sum("inside").alias("inside"))
    x = (
        edge.join(same, ["doc_id", "core"], "left").join(offsets, ["doc_id", "offset"], "left").join(spread, "core", "left").join(interior, "core", "left")
        .withColumn("repeats", F.log1p(F.coalesce("same_pages", F.lit(0))) - F.log1p(F.coalesce("inside", F.lit(0))))
        .withColumn("agreement", F.log1p(F.coalesce("agree", F.lit(0))) * F.col("has_number"))
        .withColumn("spread", F.coalesce(F.log(F.col("docs") / F.col("all_pages")), F.lit(0.0)))
    )
    sure = F.when((F.col("alone_number") == 1) & (F.coalesce("agree", F.lit(0)) >= 3), 1).when(
        (F.col("same_pages") >= 4) & (F.coalesce("inside", F.lit(0)) == 0) & (F.col("stops") == 0) & (F.col("docs") * 4 <= F.col("all_pages")), 1
    ).when((F.col("has_number") == 0) & (F.col("same_pages") == 1) & ((F.col("stops") == 1) | (F.col("small_start") == 1)), 0).when(F.coalesce("inside", F.lit(0)) >= 3, 0)
    x = written(x.withColumn("label", sure), "scan-edges")
    model = Logistic(_LINE_FEATURES).fit_rows(x.where("label is not null"), "label", training_rows)
    number_ok = (F.col("alone_number") == 0) | (F.coalesce("agree", F.lit(0)) >= 2) | (model.odds() > 0)
    return x.where((model.odds() > 0) & number_ok).select("doc_id", "page_index", "line_no", "core", F.when(F.coalesce("agree", F.lit(0)) >= 1, F.col("number")).otherwise("").alias("number"))


def _body(text: str, furniture: set[int]) -> list[list[str]]:
    """Paragraphs of lines, without furniture; a blank line parts paragraphs."""
    paragraphs: list[list[str]] = [[]]
    for i, line in enumerate(text_lines(text)):
        if i in furniture:
            continue
        if line.strip():
            paragraphs[-1].append(line.strip())
        elif paragraphs[-1]:
            paragraphs.append([])
    return [p for p in paragraphs if p]


def _page_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct words of each page, and the halves of words broken over lines."""
    for batch in batches:
        rows = []
        for doc, page, text, furniture in zip(batch["doc_id"], batch["page_index"], batch["text"], batch["furniture"]):
            words, breaks = Counter(), Counter()
            for paragraph in _body(text, set(furniture) if furniture is not None else set()):
                carried = False
                for i, line in enumerate(paragraph):
                    tokens = line.split()
                    first = tokens[0] if tokens else ""
                    if carried and tokens:
                        tokens = tokens[1:]
                    carried = False
                    last = (tokens or [first])[-1]
                    if i + 1 < len(paragraph) and _JOINED.match(last) and paragraph[i + 1][0].isalnum():
                        breaks[last, paragraph[i + 1].split()[0]] += 1
                        tokens, carried = tokens[:-1], True
                    words.update(w for t in tokens if (w := word_of(t)))
            rows += [(doc, page, w, "", "", n) for w, n in words.items()] + [(doc, page, "", a, b, n) for (a, b), n in breaks.items()]
        yield pd.DataFrame(rows, columns=["doc_id", "page_index", "word", "head", "tail", "n"])


def _clean_half(raw: str, head: bool) -> str:
    low = raw.lower()
    return _WORD_START.sub("", low).rstrip(HYPHENS) if head else _WORD_END.sub("", low)


def _break_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        a, b = [_clean_half(x, True) for x in batch["head"]], [_clean_half(x, False) for x in batch["tail"]]
        hard = [x[-1:] == "-" or x[-1:] in "‐‑" for x in batch["head"]]
        yield pd.DataFrame({
            "head": batch["head"], "tail": batch["tail"], "a": a, "b": b, "joined": [x + y for x, y in zip(a, b)], "kept": [x + "-" + y for x, y in zip(a, b)],
            "hard": [float(h) for h in hard], "short": [float(min(len(x), len(y)) <= 2) for x, y in zip(a, b)], "capital": [float(y[:1].isupper() or not x[-2:-1].isalpha()) for x, y in zip(batch["head"], batch["tail"])],
        })


_BREAK_FEATURES = ["joined_seen", "kept_seen", "a_seen", "b_seen", "both_seen", "hard", "short", "capital"]


def broken_words(tokens: DataFrame, vocabulary: DataFrame, training_rows: int = 20_000) -> DataFrame:
    """``(head, tail, word)``: how each distinct pair of halves reads.

    The model learns from pairs of which exactly one reading is in the
    vocabulary; half of them are shown without that knowledge, so that it also
    decides where neither reading was seen.
    """
    distinct = tokens.where("head <> ''").select("head", "tail").distinct()
    forms = distinct.mapInPandas(_break_forms, "head string, tail string, a string, b string, joined string, kept string, hard double, short double, capital double")
    x = forms
    for part in ("joined", "kept", "a", "b"):
        x = x.join(vocabulary.select(F.col("word").alias(part), F.log1p("n").alias(f"{part}_seen")), part, "left").fillna(0.0, [f"{part}_seen"])
    x = written(x.withColumn("both_seen", F.least("a_seen", "b_seen")), "scan-breaks")
    blind = F.pmod(F.xxhash64("head", "tail"), F.lit(2)) == 0
    label = F.when((F.col("joined_seen") > 0) & (F.col("kept_seen") == 0), 1).when((F.col("kept_seen") > 0) & (F.col("joined_seen") == 0), 0)
    known = x.withColumn("label", label).where("label is not null")
    for part in ("joined_seen", "kept_seen"):
        known = known.withColumn(part, F.when(blind, F.lit(0.0)).otherwise(F.col(part)))
    model = Logistic(_BREAK_FEATURES).fit_rows(known, "label", training_rows)
    return x.select("head", "tail", F.when((F.col("hard") == 0) | (model.odds() > 0), F.col("joined")).otherwise(F.col("kept")).alias("word"))


def _pair_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts in which a word and its candidate differ; far pairs are left out.

    So are pairs that differ by added or missing letters, as other forms of a
    word and words of related languages do.
    """
    for batch in batches:
        rows = []
        for word, cand, n, m, shared in zip(batch["word"], batch["cand"], batch["n"], batch["cand_n"], batch["shared"]):
            pre = 0
            while pre < min(len(word), len(cand)) and word[pre] == cand[pre]:
                pre += 1
            post = 0
            while post < min(len(word), len(cand)) - pre and word[-1 - post] == cand[-1 - post]:
                post += 1
            a, b = word[pre : len(word) - post], cand[pre : len(cand) - post]
            if len(a) <= 2 and len(b) <= 2 or (len(a) <= 3 and len(b) <= 3 and pre + post >= 4):
                parts = [f"{a}>{b}"]
            else:
                ops = [(word[i:j], cand[k:m_]) for tag, i, j, k, m_ in SequenceMatcher(None, word, cand, autojunk=False).get_opcodes() if tag != "equal"]
                if len(ops) > 3 or any(len(s) > 2 or len(t) > 2 for s, t in ops) or len(word) < 6:
                    continue
                parts = [f"{s}>{t}" for s, t in ops]
            if any(p[0] == ">" or p[-1] == ">" for p in parts):  # a misread character stands for at least one
                continue
            change = sum(len(p) - 1 for p in parts)
            rows.append((word, cand, n, m, parts, float(len(parts)), float(change), float(pre), float(post), float(len(word)), float(shared)))
        yield pd.DataFrame(rows, columns=["word", "cand", "n", "cand_n", "parts", "chunks", "change", "pre", "post", "length", "shared"])


def _gram_rows(words: DataFrame, name: str) -> DataFrame:
    """Padded trigrams, and bigrams of words of up to seven letters."""
    padded = F.concat(F.lit("^"), F.col(name), F.lit("$"))
    size = F.length(padded)

    def grams(q: int) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(size - (q - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(q)))

    both = F.when(size <= 6, grams(2)).when(size <= 9, F.concat(grams(2), grams(3))).otherwise(grams(3))
    return words.withColumn("gram", F.explode(F.array_distinct(both)))


SPOILT = 12
_RANK_FEATURES = ["others", "ratio", "cand_log", "word_log", "support", "chunks", "pre", "post", "length", "shared"]


def correction_pairs(words: DataFrame, lead: float = 8.0) -> DataFrame:
    """Candidates of every word of ``words(word, n)`` with their features.

    A word is joined with all words at least ``lead`` times as frequent that
    share one of its ``SPOILT + 1`` rarest q-grams. Three changed parts of two
    letters spoil at most four trigrams each, so one of these q-grams is whole
    and no candidate within those changes is lost; shorter words are joined
    through all their q-grams.
    """
    known = words.where("n >= 2 and word rlike '^([0-9]{1,3}-)?[\\\\p{L}][\\\\p{L}\\'’–\\\\-]+$'").select(F.col("word").alias("cand"), F.col("n").alias("cand_n"))
    index = _gram_rows(known, "cand")
    df = index.groupBy("gram").agg(F.count("*").alias("df"))
    asked = _gram_rows(words.where("length(word) >= 2 and word rlike '\\\\p{L}'"), "word").join(df, "gram")
    rank = Window.partitionBy("word").orderBy("df", "gram")
    asked = asked.withColumn("r", F.row_number().over(rank)).where((F.col("r") <= SPOILT + 1) | (F.length("word") <= 7)).select("word", "n", "gram")
    near = (F.abs(F.length("word") - F.length("cand")) <= 2) & (F.col("cand_n") >= lead * F.greatest("n", F.lit(0.2))) & (F.col("word") != F.col("cand"))
    joined = asked.join(index, "gram").where(near).groupBy("word", "n", "cand", "cand_n").agg(F.count("*").alias("shared"))
    joined = joined.where(F.levenshtein("word", "cand", 6) >= 0)  # three parts of two letters are six edits at most
    pairs = joined.mapInPandas(
        _pair_features,
        "word string, cand string, n bigint, cand_n bigint, parts array<string>, chunks double, change double, pre double, post double, length double, shared double",
    )
    return pairs


def corrections(words: DataFrame, training_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """``(word, right)`` for the words of ``words(word, n)`` with misread characters.

    The trees learn from words with a digit or sign among letters, which are
    misread beyond doubt: their most frequent close candidate is right and the
    others wrong; pairs of letters-only words of similar frequency are wrong,
    and a change seen in several words is right if the candidate is far more
    frequent.
    What a confusion is, is learnt too: ``support`` counts the distinct words
    in which the same characters differ against a far more frequent word, and
    ``others`` how often these words occur but for the word itself; a frequent
    word that stands alone with its change is a word of its own.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pairs = written(correction_pairs(words), "scan-pairs")
    part = pairs.where("cand_n >= 20 * n").select("word", "n", F.explode("parts").alias("part")).distinct()
    support = part.groupBy("part").agg(F.count("*").alias("words"), F.sum("n").alias("total"))
    of_pair = pairs.select("word", "cand", "n", F.explode("parts").alias("part")).join(support, "part", "left")
    rest = F.greatest(F.lit(0), F.coalesce("total", F.lit(0)) - F.col("n"))
    lowest = of_pair.groupBy("word", "cand").agg(F.log1p(F.min(F.coalesce("words", F.lit(0)))).alias("support"), F.log1p(F.min(rest)).alias("others"))
    x = pairs.join(lowest, ["word", "cand"]).withColumn("word_log", F.log1p("n")).withColumn("cand_log", F.log1p("cand_n")).withColumn("ratio", F.log(F.col("cand_n") / F.greatest("n", F.lit(0.2))))
    odd = F.col("word").rlike(r"\p{L}[0-9@!|$]+\p{L}|^[0-9@!|$]\p{L}{3,}|\p{L}{3,}[0-9@!|$]$") & ~F.col("word").rlike(r"^[a-z]{1,3}[0-9]+|-[0-9]|[0-9]-")
    best = Window.partitionBy("word").orderBy("chunks", "change", F.desc("cand_n"), "cand")
    x = x.withColumn("odd", odd).withColumn("r", F.row_number().over(best))
    similar = ~F.col("odd") & (F.col("n") >= 3) & (F.col("ratio") < F.log(F.lit(14.0)))
    common = ~F.col("odd") & (F.col("r") == 1) & (F.col("chunks") == 1) & (F.col("support") >= F.log1p(F.lit(4))) & (F.col("ratio") >= F.log(F.lit(60.0))) & (F.col("pre") + F.col("post") >= 3)
    own = ~F.col("odd") & (F.col("n") >= 5) & (F.col("others") < F.col("word_log"))  # a change that is seen in one word above all makes that word one of its own
    label = F.when(own, 0.0).when(common | F.col("odd") & (F.col("r") == 1) & (F.col("chunks") <= 2), 1.0).when(F.col("odd") & (F.col("r") > 1), 0.0).when(similar, 0.0).when(~F.col("odd") & (F.col("support") < F.log1p(F.lit(2))), 0.0)
    x = written(x.withColumn("label", label), "scan-ranked")
    sample = bounded_sample(x.where("label is not null").select(*_RANK_FEATURES, "label", "word", "cand"), ["word", "cand"], training_rows)
    sample = written(sample, "scan-sample")
    if sample.select("label").distinct().count() < 2:
        return x.where("odd and r = 1").select("word", F.col("cand").alias("right"))
    vector = VectorAssembler(inputCols=_RANK_FEATURES, outputCol="features")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.3, seed=7).fit(vector.transform(sample))
    scored = model.transform(vector.transform(x)).withColumn("p", F.element_at(vector_to_array("probability"), 2))
    first = Window.partitionBy("word").orderBy(F.desc("p"), F.desc("cand_n"), "cand")
    return scored.where(F.col("p") >= threshold).withColumn("k", F.row_number().over(first)).where("k = 1").select("word", F.col("cand").alias("right"))


def scan_traces(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages, and one row ``(doc_id, page_index, noise, raw, value)`` per trace.

    ``noise`` is hyphenation, character, running_line or page_number; ``raw``
    is the word, the pair of halves or the line number that the trace stands
    in. Hits of one page count once. Null excerpts, documents or page numbers
    give no rows; empty excerpts have no traces; texts are read whole.
    """
    pages = written(scanned_pages(hits), "scan-pages")
    furniture = written(page_furniture(pages), "scan-furniture")
    per_page = furniture.groupBy("doc_id", "page_index").agg(F.collect_set("line_no").alias("furniture"))
    whole = pages.join(per_page, ["doc_id", "page_index"], "left")
    tokens = written(whole.mapInPandas(_page_tokens, "doc_id string, page_index int, word string, head string, tail string, n bigint"), "scan-tokens")
    vocabulary = written(tokens.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "scan-vocabulary")
    breaks = written(broken_words(tokens, vocabulary), "scan-joins")
    unseen = breaks.select("word").distinct().join(vocabulary, "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n"))
    right = written(corrections(vocabulary.union(unseen)), "scan-right")
    single = tokens.where("word <> ''").join(right, "word").select("doc_id", "page_index", F.lit("character").alias("noise"), F.col("word").alias("raw"), F.col("right").alias("value"))
    halves = tokens.where("head <> ''").select("doc_id", "page_index", "head", "tail").join(breaks, ["head", "tail"]).join(right, "word", "left")
    halves = halves.withColumn("raw", F.concat("head", F.lit(" "), "tail")).withColumn("value", F.coalesce("right", "word"))
    hyphened = halves.select("doc_id", "page_index", F.lit("hyphenation").alias("noise"), "raw", "value")
    both = halves.where("right is not null").select("doc_id", "page_index", F.lit("character").alias("noise"), "raw", "value")
    lines = furniture.where("core <> ''").select("doc_id", "page_index", F.lit("running_line").alias("noise"), F.col("line_no").cast("string").alias("raw"), F.col("core").alias("value"))
    numbers = furniture.where("number <> ''").select("doc_id", "page_index", F.lit("page_number").alias("noise"), F.col("line_no").cast("string").alias("raw"), F.col("number").alias("value"))
    return pages, single.union(hyphened).union(both).union(lines).union(numbers)


def _cased(raw: str, right: str) -> str:
    return right.upper() if len(raw) > 1 and raw.isupper() else right[:1].upper() + right[1:] if raw[:1].isupper() else right


_JOIN_FEATURES = ["prev_stop", "prev_hyphen", "prev_comma", "prev_short", "next_small", "next_capitals", "next_numbered", "next_short"]


def _join_features(prev: str, line: str, width: int) -> list[float]:
    letters = [c for c in line if c.isalpha()]
    return [
        float(prev[-1] in ".!?:\"”’)"), float(prev[-1] in HYPHENS), float(prev[-1] in ",;"), 1 - min(1.0, len(prev) / width), float(line[0].islower()),
        float(bool(letters) and sum(c.isupper() for c in letters) > 0.6 * len(letters)), float(bool(re.match(r"\d+(\.\d+)*\.? +[^\W\d]", line))), float(len(line) < 0.6 * width and line[-1] not in ".,;" + HYPHENS),
    ]


def _body_lines(text: str, furniture: set[int]) -> list[tuple[str, bool]]:
    """Lines without furniture and blank ones, and whether a blank line stands before each."""
    out, blank = [], True
    for i, line in enumerate(text_lines(text)):
        if i not in furniture and line.strip():
            out.append((line.strip(), blank))
            blank = False
        elif i not in furniture:
            blank = True
    return out


def _line_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, furniture in zip(batch["text"], batch["furniture"]):
            lines = _body_lines(text, set(furniture) if furniture is not None else set())
            width = max((len(x) for x, _ in lines), default=1)
            rows += [(*_join_features(a, b, width), int(blank)) for (a, _), (b, blank) in zip(lines, lines[1:])]
        yield pd.DataFrame(rows, columns=[*_JOIN_FEATURES, "label"])


def paragraph_model(pages: DataFrame, training_rows: int = 20_000) -> Logistic:
    """How likely a new paragraph begins between two lines, by their form.

    It learns from where blank lines stand in the ``pages(text, furniture)``,
    which are no feature; so it finds paragraphs that have lost their blank
    line, and blank lines inside a sentence.
    """
    pairs = pages.mapInPandas(_line_pairs, ", ".join(f"{f} double" for f in _JOIN_FEATURES) + ", label int")
    return Logistic(_JOIN_FEATURES).fit_rows(pairs, "label", training_rows)


def paragraphs(text: str, furniture: set[int], weights: list[float], breaks: float = 2.0, joins: float = -3.0) -> list[list[str]]:
    """Lines of each paragraph: blank lines part them but where the log odds are below ``joins``, other lines where they are above ``breaks``."""
    lines = _body_lines(text, furniture)
    width = max((len(x) for x, _ in lines), default=1)
    out: list[list[str]] = []
    for k, (line, blank) in enumerate(lines):
        odds = weights[-1] + sum(w * x for w, x in zip(weights, _join_features(lines[k - 1][0], line, width))) if k else 0.0
        if not k or odds > (joins if blank else breaks):
            out.append([])
        out[-1].append(line)
    return out


def _repaired(batches: Iterator[pd.DataFrame], weights: list[float]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, traces in zip(batch["text"], batch["traces"]):
            rows = [(t["noise"], t["raw"], t["value"]) for t in (traces if traces is not None else [])]
            furniture = {int(raw) for noise, raw, _ in rows if noise in ("running_line", "page_number")}
            words = {raw: value for noise, raw, value in rows if noise == "character" and " " not in raw}
            joins = {raw: value for noise, raw, value in rows if noise == "hyphenation"}

            def fixed(token: str) -> str:
                core = word_of(token)
                if core not in words:
                    return token
                at = token.lower().find(core)
                return token[:at] + _cased(token[at : at + len(core)], words[core]) + token[at + len(core) :]

            whole = []
            for lines in paragraphs(text, furniture, weights):
                tokens: list[str] = []
                for line in lines:
                    new = line.split()
                    if tokens and new and (word := joins.get(f"{tokens[-1]} {new[0]}")):
                        head = _WORD_START.match(tokens[-1].lower())
                        lead = tokens[-1][: head.end()] if head else ""
                        end = _WORD_END.search(new[0])
                        tokens[-1] = lead + _cased(tokens[-1][len(lead) :], word) + (end.group() if end else "")
                        new = new[1:]
                    tokens += new
                whole.append(" ".join(fixed(t) for t in tokens))
            out.append(unicodedata.normalize("NFC", "\n\n".join(whole)))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "page_index": batch["page_index"], "text": out})


def repair_pages(hits: DataFrame) -> DataFrame:
    """``(doc_id, page_index, text)``: each page as continuous paragraphs."""
    pages, traces = scan_traces(hits)
    per_page = traces.groupBy("doc_id", "page_index").agg(F.collect_set(F.struct("noise", "raw", "value")).alias("traces"))
    whole = written(pages.join(per_page, ["doc_id", "page_index"], "left"), "scan-whole")
    furniture = F.transform(F.filter("traces", lambda t: t["noise"].isin("running_line", "page_number")), lambda t: t["raw"].cast("int"))
    weights = [float(w) for w in paragraph_model(whole.select("text", furniture.alias("furniture"))).weights]
    return whole.mapInPandas(lambda batches: _repaired(batches, weights), "doc_id string, page_index int, text string")

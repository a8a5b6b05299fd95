"""Broken prompt and response pairs.

The clauses of a response are tagged as answer, refusal, echo, foreign or
unfinished by a conditional random field; how much of the response each tag
covers then gives the defect of the pair.

The field is not taught by rules over its own features: it learns from pairs
of the table that are spoilt on purpose (``spoilt``), so the tag of every
clause is known however the clause looks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.clauses import BINS, PLACEHOLDER, SEEDS, TRIGRAMS, WIDTH, Encoded, Languages, Names, Queries, best_fits, encode
from caseloom.llm.crf import ChainCRF, ranges
from caseloom.session import spread, written

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

# Words of a clause tell for or against declining only, and the last words for or against an open end; the other tags go by the form.
FREE = np.ones((WIDTH, len(TAGS)), bool)
FREE[: 2 * BINS] = np.arange(len(TAGS)) == REFUSAL
FREE[2 * BINS : 3 * BINS] = np.arange(len(TAGS)) == UNFINISHED
# A single word can speak for declining, but hardly against it: that long sentences hold common words says little.
LEAST = np.full((WIDTH, len(TAGS)), -np.inf)
LEAST[:BINS, REFUSAL] = -0.05

_LABELLED = re.compile(r"^[\W_]*(?:(?:[^\W\d_]{1,12}\s*)?#?\s*\d{1,2}\s*[:.)](?=\s|\*|$)|[^\W\d_]{2,16}\s*[:：])\s*")
_RANK = re.compile(r"^[\W_]*(?:[^\W\d_]{1,12}\s*)?#?\s*\d{1,2}\s*[:.)](?=\s|\*|$)[ \t*_`]*(.*)$", re.M)
_LISTED = re.compile(r"^([\W_]*(?:[^\W\d_]{1,12}\s*)?#?\s*\d{1,2}\s*[:.)])[ \t].*$", re.M)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W_]+")

# Sentences that decline, and such as only hedge, to be spoilt with; what other wordings share with them is learnt.
_DO = ["answer this question", "give a diagnosis", "provide medical advice", "help with this request", "assess this case", "interpret these findings", "comment on this patient", "discuss this case", "name a disease", "offer an opinion", "make a recommendation", "say anything about this"]
_STARTS = ["I", "I", "I", "We", "Sorry, I", "I'm sorry, but I", "I apologise, but I", "Unfortunately I", "As an AI model, I", "As a language model I", "As an assistant I", "Here I", "With regret I", "I fear that I"]
_VERBS = [
    "am unable to {}", "cannot {}", "can't {}", "won't {}", "will not {}", "must decline to {}", "have to decline to {}", "decline to {}", "am not able to {}", "am not allowed to {}", "refuse to {}", "must refuse to {}", "would rather not {}", "prefer not to {}",
    "may not {}", "should not {}", "must not {}", "do not want to {}", "do not feel comfortable to {}", "am not in a position to {}", "have been told not to {}", "do not {} here",
]
_DECLINES = [
    "I'm unable to {}.", "I'm not able to {}.", "I'm not permitted to {}.", "I'd rather not {}.", "I'd prefer not to {}.", "To {} is something I'm not allowed to do.", "It isn't for me to {}.", "It is not possible for me to {}.", "It would not be appropriate for me to {}.", "It would be wrong for me to {}.", "My rules do not allow me to {}.", "My policy prevents me from trying to {}.", "Nobody should ask me to {}.", "Only a clinician can {}.",
    "That is not something I can do, so I will not {}.", "I must pass on this and leave it to your doctor to {}.", "To {} is outside my role.", "I leave it to the doctors to {}.",
]
_LABELS = ["Answer", "Reasoning", "Respuesta", "Resposta"]
_LEADS = ["The case describes", "The query mentions", "You report", "The text tells of", "Thank you for telling me about", "I see", "This is about"]
_FILLS = ["not provided", "declined", "refused", "cannot be given", "withheld", "no answer", "not given", "cannot say"]
_DECLINED = [
    "This request has been declined.", "Request declined.", "Request refused.", "The request was refused.", "An answer cannot be given here.", "A diagnosis will not be offered.", "No answer can be given.", "No diagnosis will be given.", "I have no answer to that.", "I can't help with that.", "I can't assist with this.", "I am not a doctor and cannot help.", "I leave this to the doctors.", "Refused.", "Declined.",
    "No puedo responder a esta pregunta.", "Lo siento, no puedo ayudar con esto.", "Debo rechazar esta solicitud.", "Me niego a dar un diagnóstico.", "No estoy autorizado a opinar sobre este caso.", "Prefiero no responder.", "No me es posible ofrecer un diagnóstico.",
    "Não posso responder a esta pergunta.", "Desculpe, não posso ajudar com isso.", "Devo recusar este pedido.", "Recuso-me a dar um diagnóstico.", "Não estou autorizado a opinar sobre este caso.", "Prefiro não responder.", "Não me é possível oferecer um diagnóstico.",
    "Je ne peux pas répondre à cette question.", "Désolé, je dois refuser cette demande.", "Das kann ich leider nicht beantworten.", "Ich muss diese Anfrage ablehnen.", "Mi dispiace, non posso rispondere.",
]
_AFTER = ["Please consult a doctor.", "Please ask a qualified clinician.", "This is beyond what I may do.", "Your own doctor should decide.", "Ask me something else.", "Consulte a un médico.", "Procure um médico.", "Veuillez consulter un médecin."]
_HEDGES = ["This is not medical advice.", "I am not a doctor, but the following seems likely.", "Sorry for the short answer.", "I cannot be certain without a biopsy.", "I can't examine the patient.", "I cannot exclude other causes.", "The patient declined a biopsy.", "No test was able to exclude this."]


def states_nothing(answer: str | None) -> bool:
    """Null, blanks, placeholders and bare labels."""
    if answer is None:
        return True
    if sum(1 for _ in zip(_WORD.finditer(answer), range(40))) == 40:  # labels and placeholders are fewer words
        return False
    text = re.sub(r"</?[a-z_]+>|[​﻿­]|```\w*", " ", answer)
    for line in text.split("\n"):
        while (m := _LABELLED.match(line)) and m.end():
            line = line[m.end() :]
        if not PLACEHOLDER.match(line):
            return False
    return True


@dataclass
class Example:
    """A pair and the tags of its clauses: spans of the answer, the others ``rest``."""

    query: str
    answer: str
    rest: int = ANSWER
    rank: int = ANSWER
    last: int | None = None
    spans: tuple[tuple[int, int, int], ...] = ()
    hidden: int = -1  # language profile that is not to be known
    of: int = -1  # the pair it was made of
    other: int = -1  # the pair that its answer was taken from, where that is another one


def _reworded(text: str, random: np.random.Generator, share: float) -> str:
    """``text`` with a share of its words left out, doubled or put in capitals."""
    out = []
    for w in text.split(" "):
        x = random.random()
        out += [] if x < share / 3 else [w, w] if x < share / 2 else [w.upper()] if x < share else [w]
    return " ".join(out)


def _slip(text: str, random: np.random.Generator) -> str:
    """``text`` with one letter left out, doubled or swapped with the next."""
    if len(text) < 5:
        return text
    i, x = int(random.integers(1, len(text) - 2)), random.random()
    return text[:i] + (text[i + 1 :] if x < 0.3 else text[i] + text[i:] if x < 0.6 else text[i + 1] + text[i] + text[i + 2 :])


def spoilt(pairs: list[tuple[str, str]], lang: np.ndarray, sure: np.ndarray, names: list[str], random: np.random.Generator) -> list[Example]:
    """Examples of every tag made of ``pairs``, taken to be sound; ``lang`` is the language of each query.

    Pairs that are ``sure`` to be sound get answers of such pairs only.

    Cut answers, parts of the query as answer, answers to a query of another
    language, declining sentences with and without a lead, and sound ones in
    other shapes: without a last full stop, only ranks, only reasoning, a bare
    name, with a hedge.
    """
    out: list[Example] = []
    below = lambda n: int(random.random() * n)
    pick = lambda of: of[below(len(of))]
    by_lang = {on: {int(k): np.flatnonzero((lang == k) & (sure | (not on))).tolist() for k in np.unique(lang[sure | (not on)])} for on in (True, False)}
    for i, ((query, answer), on) in enumerate(zip(pairs, sure.tolist())):
        made = len(out)
        text = answer.rstrip()
        x = random.random()
        if len(text) > 12:  # a cut anywhere but behind a full stop
            least, most = (max(1, len(text) // 8), len(text) - 1) if random.random() < 0.9 else (5, min(40, len(text) - 1))
            cut = least + below(most - least)
            if not re.search(r"[.!?\]]\W*$", text[:cut]) and text[:cut].strip() and re.match(r"[\w\s]", text[cut:]):
                dots = random.random()
                out.append(Example(query, text[:cut] + ("..." if dots < 0.04 else "…" if dots < 0.08 else "-" if dots < 0.1 else ""), last=UNFINISHED))
        if random.random() < 0.12 and (marks := list(_LISTED.finditer(text))):  # a cut in the list: behind a label, or a line that is not the last
            m = pick(marks)
            end = m.end(1) if random.random() < 0.5 or m is marks[-1] else m.end()
            out.append(Example(query, text[:end], last=UNFINISHED))
        if x < 0.05 and re.search(r"\w\.$", text):
            out.append(Example(query, text[:-1]))
        if random.random() < 0.35 and (sentences := [m.span() for m in _SENTENCE.finditer(query) if m.group().strip()]):
            a = below(len(sentences))
            b = len(sentences) if random.random() < 0.5 else a + below(len(sentences) - a) + 1
            a = 0 if random.random() < 0.5 else a
            part = query[sentences[a][0] : sentences[b - 1][1]].strip()
            if part:
                part = _reworded(part, random, 0.12) if random.random() < 0.4 else part
                part = re.sub(r"[.,;:!?]", "", part) if random.random() < 0.2 else part
                out.append(Example(query, part, ECHO, ECHO))
        if random.random() < 0.35 and (others := [k for k in by_lang[on] if k != lang[i]]):
            k = pick(others)
            j = pick(by_lang[on][k])
            out.append(Example(query, pairs[j][1], FOREIGN, hidden=k if random.random() < 0.5 else -1, other=j))
            out.append(Example(pairs[j][0], answer, FOREIGN, hidden=int(lang[i]) if random.random() < 0.5 else -1))
        if random.random() < 0.5:
            x, does = random.random(), pick(_DO)
            decline = f"{pick(_STARTS)} {pick(_VERBS).format(does)}." if x < 0.55 else pick(_DECLINES).format(does) if x < 0.75 else pick(_DECLINED)
            decline = decline.replace("'", "’") if random.random() < 0.2 else decline
            decline = f"{pick(_LABELS)}: {decline}" if random.random() < 0.1 else decline
            lead = ""
            if random.random() < 0.5:  # after words of this or another query
                of = (query if random.random() < 0.5 else pick(pairs)[0]).split()
                start = below(max(1, len(of) - 6))
                words = " ".join(of[start : start + 3 + below(6)]).strip(".!?:")
                lead = f"{pick(_LEADS)} {words}. " if words else ""
            fill = pick(_FILLS)
            head = "".join(f"Rank {k + 1}: {fill}\n" for k in range(1 + below(3))) if random.random() < 0.25 else ""
            tail = " " + pick(_AFTER) if random.random() < 0.4 else ""
            out.append(Example(query, head + lead + decline + tail, REFUSAL, REFUSAL, spans=((len(head), len(head) + len(lead), ANSWER),) if lead else ()))
        x = random.random()
        if x < 0.05 and names:
            name = pick(names)
            name = _slip(name, random) if random.random() < 0.5 else name
            out.append(Example(query, pick(["{}.", "{}", "Likely {}.", "{} [1].", "Probable {}."]).format(name[:1].upper() + name[1:])))
        elif x < 0.12:
            out.append(Example(query, pick(_HEDGES) + " " + text))
        elif x < 0.2:
            lines = [line for line in text.split("\n") if _RANK.match(line)]
            rest = "\n".join(line for line in text.split("\n") if not _RANK.match(line)).strip()
            if lines and x < 0.15:
                out.append(Example(query, "\n".join(lines)))
            elif rest:
                out.append(Example(query, rest))
        for e in out[made:]:
            e.of = i
    return out


class Tagger:
    """The fitted field with the languages and names it knows."""

    def __init__(self, field: ChainCRF, languages: Languages, names: Names, typical: float):
        self.field, self.languages, self.names, self.typical = field, languages, names, typical

    def encode(self, queries: list[str], answers: list[str], hidden: np.ndarray | None = None, known: Queries | None = None) -> Encoded:
        return encode(queries, answers, self.languages, self.names, self.typical, hidden, known)

    def tags(self, x: Encoded) -> np.ndarray:
        out = np.zeros(len(x.sizes), int)
        there = x.lengths[x.lengths > 0]
        return self.field.decode(self.field.scores(x.ids, x.sizes), there) if len(there) else out

    def defects(self, queries: list[str | None], answers: list[str | None]) -> list[str | None]:
        out: list[str | None] = ["empty" if states_nothing(a) else None for a in answers]
        open_ = [i for i, d in enumerate(out) if d is None]
        if not open_:
            return out
        x = self.encode([queries[i] or "" for i in open_], [answers[i] for i in open_])
        for i, d in zip(open_, pair_defects(x, self.tags(x))):
            out[i] = d
        return out


def pair_defects(x: Encoded, tags: np.ndarray) -> list[str | None]:
    """The defect of each pair that the coverage of its clauses shows, or None."""
    n = len(x.lengths)
    owner = np.repeat(np.arange(n), x.lengths)
    cover = [np.bincount(owner, x.chars * (tags == t), n) for t in range(len(TAGS))]
    total = np.maximum(np.bincount(owner, x.chars, n), 1)
    ranks = np.bincount(owner, (x.rank == 2) & (tags != ECHO) & (tags != REFUSAL), n)
    reasoned = (x.rank == 0) & (x.words >= np.where(x.named, 5, 3))  # a bare name is no reasoning
    reasoning = np.bincount(owner, x.chars * reasoned, n)
    foreign = np.bincount(owner, x.chars * (reasoned & (tags == FOREIGN)), n)
    names = np.bincount(owner, x.named & np.isin(tags, (ANSWER, FOREIGN, UNFINISHED)), n)
    said = np.bincount(owner, x.words, n)
    answered = np.bincount(owner, x.named & (tags == ANSWER), n)
    end = np.cumsum(x.lengths) - 1
    unfinished = np.zeros(n, bool)
    unfinished[x.lengths > 0] = tags[end[x.lengths > 0]] == UNFINISHED
    out: list[str | None] = []
    for i in range(n):
        if not x.lengths[i]:
            out.append("empty")
        elif not ranks[i] and not answered[i] and said[i] >= 4 and cover[ECHO][i] >= 0.75 * total[i]:
            out.append("copied_question")
        elif cover[REFUSAL][i] and not ranks[i] and (not names[i] or cover[REFUSAL][i] >= 0.5 * total[i]):
            out.append("refusal")
        elif reasoning[i] and foreign[i] >= 0.5 * reasoning[i]:
            out.append("other_language")
        else:
            out.append("truncated" if unfinished[i] else None)
    return out


def _labels(examples: list[Example], x: Encoded) -> np.ndarray:
    """The tags of the clauses of the examples."""
    first = np.cumsum(x.lengths) - x.lengths
    rest, rank = (np.repeat(np.array(of, int), x.lengths) for of in ([e.rest for e in examples], [e.rank for e in examples]))
    labels = np.where((x.rank > 0) | (x.words == 0), rank, rest)
    for e, start, n in zip(examples, first.tolist(), x.lengths.tolist()):
        for a, b, tag in e.spans:
            at = x.start[start : start + n]
            labels[start : start + n][(a <= at) & (at < b)] = tag
        if n and e.last is not None:
            labels[start + n - 1] = e.last
    return labels


def _training(x: Encoded, labels: np.ndarray, chosen: np.ndarray, most_clauses: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and tags of the ``chosen`` examples; of longer ones the last ``most_clauses`` clauses.

    Words and pairs of words are features only if some clause that declines has
    them, and last words only if eight examples end so: others would be learnt
    by heart, with the defects that the pairs had before they were spoilt.
    """
    chosen = chosen[x.lengths[chosen] > 0]
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0, int)
    lengths = np.minimum(x.lengths[chosen], most_clauses)
    clauses = ranges(np.cumsum(x.lengths)[chosen] - lengths, lengths)
    sizes, labels = x.sizes[clauses], labels[clauses]
    ids = x.ids[ranges((np.cumsum(x.sizes) - x.sizes)[clauses], sizes)]
    declining, seen = np.zeros(WIDTH, bool), np.bincount(ids, minlength=WIDTH)
    declining[ids[np.repeat(labels == REFUSAL, sizes)]] = True
    form = np.arange(WIDTH)
    kept = np.where(form < 2 * BINS, declining, (form >= 3 * BINS) | (seen >= 8))[ids]
    return ids[kept], np.add.reduceat(kept.astype(np.int64), np.cumsum(sizes) - sizes), lengths, labels


def rank_names(pairs: DataFrame, answer: str = "answer", least_share: float = 1e-5, least: int = 3, most: int = 200_000) -> list[str]:
    """Values of rank lines over all answers, most frequent first.

    Those that make up ``least_share`` of all rank lines and stand in
    ``least`` of them or more, at most 1 / ``least_share`` values.
    """
    value = F.explode(F.regexp_extract_all(F.lower(F.col(answer)), F.lit(r"(?m)^[^\p{L}\p{N}\n]*(?:\p{L}{1,12}[ \t]*)?#?[ \t]*\d{1,2}[ \t]*[:.)](?=[ \t*])[ \t*_`]*(.*)$"), F.lit(1)))
    spaced = F.trim(F.regexp_replace("value", r"[^\p{L}\p{N}]+", " "))
    counts = pairs.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("k")).select(spaced.alias("name"), "k").where(F.length("name").between(2, 80)).groupBy("name").agg(F.sum("k").alias("n"))
    counts = written(counts, "rank-names")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = counts.where(F.col("n") >= max(least, least_share * total)).orderBy(F.desc("n"), "name").limit(most).collect()
    return [r["name"] for r in rows if not PLACEHOLDER.match(r["name"])]


def _slices(frames: Iterator[pd.DataFrame], columns: list[str], slice_chars: int = 1_500_000) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in parts of about ``slice_chars`` characters."""
    for whole in frames:
        chars = sum(whole[c].str.len().fillna(0) for c in columns).cumsum().to_numpy()
        for _, part in whole.groupby(chars // slice_chars, sort=False):
            yield part


def learnt_languages(texts: DataFrame, sweeps: int = 2) -> Languages:
    """The profiles of all ``texts(text)``, each given ``n`` times if there is such a column; counted in tasks, only the sums reach the driver."""
    out = Languages()
    texts = texts if "n" in texts.columns else texts.withColumn("n", F.lit(1))
    for sweep in range(sweeps):
        seen = texts.sparkSession.sparkContext.broadcast(out)

        def run(frames: Iterator[pd.DataFrame], seeded: bool = sweep == 0, seen=seen) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(SEEDS) * TRIGRAMS)
            for part in _slices(frames, ["text"]):
                total += seen.value.counts([t.lower() for t in part["text"]], seeded, part["n"].to_numpy()).ravel()
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "n": total[at].astype(np.int64)})

        rows = texts.mapInPandas(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(SEEDS) * TRIGRAMS)
        counts[[r["at"] for r in rows]] = [r["n"] for r in rows]
        out.settle(counts.reshape(len(SEEDS), TRIGRAMS))
    return out


def typical_fit(texts: DataFrame, languages: Languages) -> float:
    """The median over all ``texts(text, n)``, each ``n`` times, of how well their language fits them, to three places."""
    known = texts.sparkSession.sparkContext.broadcast(languages)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(frames, ["text"]):
            fits = best_fits(part["text"].tolist(), known.value)
            yield pd.DataFrame({"fit": np.round(fits, 3), "n": part["n"].to_numpy()})[np.isfinite(fits)]

    rows = texts.mapInPandas(run, "fit double, n bigint").groupBy("fit").agg(F.sum("n").alias("n")).orderBy("fit").collect()
    sums = np.cumsum([r["n"] for r in rows])
    return float(np.mean([rows[int(np.searchsorted(sums, k, side="right"))]["fit"] for k in ((sums[-1] - 1) // 2, sums[-1] // 2)])) if rows else -8.0


def common_words(queries: DataFrame, share: float = 0.005) -> list[str]:
    """Words that more than ``share`` of all ``queries(text, n)`` hold, each ``n`` times."""
    words = queries.select("n", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("word"))
    total = queries.agg(F.sum("n")).first()[0] or 0
    return [r["word"] for r in words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > share * total).collect()]


def fit_share(sample: list[tuple[str, str]], known: list[str], tagger: Tagger, most_clauses: int, random: np.random.Generator) -> tuple[ChainCRF, np.ndarray]:
    """The field that the pairs of one share teach, and how often it saw each feature.

    Every pair is spoilt, and all are encoded once. A first field learns from
    the pairs that name diseases in rank lines and what was made of them. It
    then tags the whole share: the second field learns from the pairs that it
    finds sound and that name a disease, what was made of them, and the
    refusals with the tags found; the other broken ones are left out.
    """
    if not sample:
        return ChainCRF(WIDTH, len(TAGS)), np.zeros(WIDTH, int)
    listed = set(known)
    sure = np.array([any(" ".join(_WORD.findall(v.lower())) in listed for v in _RANK.findall(a)) for _, a in sample], bool)
    sure |= not sure.any()
    queries = Queries([q for q, _ in sample], tagger.languages)
    examples = [Example(q, a, of=i) for i, (q, a) in enumerate(sample)]
    examples += spoilt(sample, queries.own[[queries.index[q] for q, _ in sample]], sure, known, random)
    x = Encoded.joined([tagger.encode([e.query for e in part], [e.answer for e in part], np.array([e.hidden for e in part]), queries) for part in (examples[i : i + 500] for i in range(0, len(examples), 500))])
    labels, of, other = _labels(examples, x), np.array([e.of for e in examples], int), np.array([e.other for e in examples], int)
    made_of = lambda good: good[of] & ((other < 0) | good[other])
    training = _training(x, labels, np.flatnonzero(made_of(sure)), most_clauses)
    tagger.field = ChainCRF(WIDTH, len(TAGS)).fit(*training, epochs=6 if sure.sum() <= 1_500 else 3, free=FREE, least=LEAST)
    whole = x.head(len(sample))
    tags = tagger.tags(whole)
    defects = pair_defects(whole, tags)
    names = np.bincount(np.repeat(np.arange(len(sample)), whole.lengths), whole.named, len(sample)) > 0
    sound = np.array([d is None for d in defects], bool) & names
    refused = np.array([d == "refusal" for d in defects], bool)
    labels[: len(tags)] = np.where(np.repeat(refused, whole.lengths), tags, labels[: len(tags)])
    chosen = np.flatnonzero(made_of(sound))
    pairs = chosen < len(sample)
    training = _training(x, labels, np.concatenate([chosen[pairs], *2 * [np.flatnonzero(refused)], chosen[~pairs]]), most_clauses)
    return ChainCRF(WIDTH, len(TAGS)).fit(*training, epochs=9, free=FREE, least=LEAST), np.bincount(training[0], minlength=WIDTH)


def fit_tagger(pairs: DataFrame, share_rows: int = 4_000, most_clauses: int = 20, seed: int = 11) -> Tagger:
    """Fit on all distinct pairs of ``pairs(query, answer)``.

    They are dealt by hash into shares of about ``share_rows``; every share
    teaches a field of its own in a task, and the fields are averaged, the
    weights of a feature by how often each of them saw it. Languages, names,
    common words and the typical fit are counted over all pairs before.
    """
    spark = pairs.sparkSession
    known = rank_names(pairs.where("answer is not null"))
    digest = F.xxhash64("query", "answer")  # as in bounded samples: null and empty queries differ
    sample = written(pairs.where("answer is not null").select("query", "answer").distinct().withColumn("digest", digest), "distinct-pairs")
    said = sample.where(F.col("answer").rlike(r"[\p{L}\p{N}]"))
    queries = spread(written(said.groupBy(F.coalesce("query", F.lit("")).alias("text")).agg(F.count("*").alias("n")), "distinct-queries"))
    languages = learnt_languages(queries.unionAll(spread(said.select(F.col("answer").alias("text"), F.lit(1).cast("bigint").alias("n")))))
    tagger = Tagger(ChainCRF(WIDTH, len(TAGS)), languages, Names(known, common_words(queries)), typical_fit(queries, languages))
    shares = max(1, -(-sample.count() // share_rows))
    given = spark.sparkContext.broadcast((known, tagger))

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known, tagger = given.value
        rows = rows.sort_values(["digest", "answer"])
        of = [(q or "", a) for q, a in zip(rows["query"], rows["answer"]) if not states_nothing(a)]
        field, seen = fit_share(of, known, tagger, most_clauses, np.random.default_rng(seed + int(key[0])))
        n = float(seen.sum())
        parts = [field.emit * seen[:, None], seen, field.step * n, field.start * n, field.end * n, [n]]
        return pd.DataFrame({"sums": [np.concatenate([np.ravel(p) for p in parts]).astype(np.float64).tobytes()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.frombuffer(x, np.float64) for frame in frames for x in frame["sums"]]
        if sums:
            yield pd.DataFrame({"sums": [np.sum(sums, axis=0).tobytes()]})

    share = F.pmod("digest", F.lit(shares)).alias("share")
    dealt = sample.select("query", "answer", "digest", share).repartition(min(4 * shares, 50 * spark.sparkContext.defaultParallelism), "share")
    fields = written(dealt.groupBy("share").applyInPandas(learn, "sums binary").mapInPandas(add, "sums binary"), "fields")  # all at once, then fetched one by one
    total = 0.0
    for row in fields.toLocalIterator():
        total = total + np.frombuffer(row["sums"], np.float64)
    if np.ndim(total):
        k = len(TAGS)
        emit, seen, step, start, end, n = np.split(total, np.cumsum([WIDTH * k, WIDTH, k * k, k, k]))
        n = max(float(n[0]), 1.0)
        tagger.field.emit = (emit.reshape(WIDTH, k) / np.maximum(seen, 1)[:, None]).astype(np.float32)
        tagger.field.step, tagger.field.start, tagger.field.end = step.reshape(k, k) / n, start / n, end / n
    return tagger


def find_broken_pairs(records: DataFrame, id_col: str = "answer_id", query: str = "query", answer: str = "answer", slice_chars: int = 1_500_000) -> DataFrame:
    """``(answer_id, defect)`` per defective pair.

    ``defect`` is empty, truncated, refusal, copied_question or
    other_language. A null answer is empty; a null query is an empty one;
    repeated rows give repeated rows; answers are read whole. Other columns,
    format flags among them, are not used.
    """
    spark = records.sparkSession
    pairs = records.select(F.col(id_col).cast("string").alias("answer_id"), F.col(query).alias("query"), F.col(answer).alias("answer"))
    tagger = spark.sparkContext.broadcast(fit_tagger(pairs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, ["answer", "query"], slice_chars):
            found = tagger.value.defects(batch["query"].tolist(), batch["answer"].tolist())
            rows = [(k, d) for k, d in zip(batch["answer_id"].tolist(), found) if d]
            yield pd.DataFrame(rows, columns=["answer_id", "defect"])

    kind = records.schema[id_col].dataType.simpleString()
    return spread(pairs).mapInPandas(run, "answer_id string, defect string").withColumn("answer_id", F.col("answer_id").cast(kind))

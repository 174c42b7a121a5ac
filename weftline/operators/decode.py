"""Reading of frame scores as label sequences or as words: prefix beam search, with a lexicon and a back-off language model."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.language_model import BEGIN, END, UNKNOWN
from weftline.sources.lookup import Lookup

LN10 = math.log(10.0)
#: Answers of the model that a search keeps.
KEPT_ANSWERS = 200_000


def log_softmax(scores: np.ndarray) -> np.ndarray:
    x = scores - scores.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class WordScorer:
    """What the words of a prefix add to the score of its frames.

    A state is (partial word, words before it, sum over complete words, look-ahead). A complete word adds ``alpha`` times the natural logarithm of its
    probability after the words before it, and ``beta``; one that the lexicon doesn't have is made less likely by ``unknown`` (log10). A partial word that begins no
    word of the lexicon already counts as ``unknown`` while prefixes are compared. ``lexicon(part)`` gives (whether it is a word,) or None if it begins none;
    ``model(gram)`` gives (log10 probability, log10 back-off weight) or None.
    """

    def __init__(self, alphabet: list[str], lexicon, model, order: int = 3, alpha: float = 0.5, beta: float = 1.5, unknown: float = -10.0):
        self.alphabet, self.delimiter, self.lexicon, self.model = alphabet, alphabet.index(" "), lexicon, model
        self.order, self.alpha, self.beta, self.unknown = order, alpha, beta, unknown
        self.most = max(beta, 0.0)  # no growth adds more
        self.known: dict = {}

    def start(self):
        return "", (BEGIN,), 0.0, 0.0

    def logp(self, word: str, before: tuple) -> float:
        """log10 of the probability of a word after others."""
        found = self.known.get((word, before))
        if found is None:
            own = self.model(" ".join((*before, word)))
            if own is not None:
                found = own[0]
            elif before:
                weight = self.model(" ".join(before))
                found = ((weight and weight[1]) or 0.0) + self.logp(word, before[1:])
            else:
                found = self.logp(UNKNOWN, ()) if word != UNKNOWN else -math.inf
            if len(self.known) > KEPT_ANSWERS:
                self.known.clear()
            self.known[word, before] = found
        return found

    def _word(self, part: str, before: tuple, total: float):
        lexical = self.lexicon(part)
        logp = self.logp(part, before) + (0.0 if lexical and lexical[0] else self.unknown)
        return (*before, part)[-(self.order - 1) :] if self.order > 1 else (), total + self.alpha * LN10 * logp + self.beta

    def grow(self, state, label: int):
        part, before, total, _ = state
        if label == self.delimiter:
            before, total = self._word(part, before, total)
            return "", before, total, 0.0
        part += self.alphabet[label]
        return part, before, total, 0.0 if self.lexicon(part) else self.unknown

    def finish(self, state) -> float:
        part, before, total, _ = state
        if part:
            before, total = self._word(part, before, total)
        return total + self.alpha * LN10 * self.logp(END, before)


class LabelScorer:
    """What ``bonus(prefix, label)`` adds whenever a prefix grows by a label."""

    delimiter, most = -1, 1e300  # a bonus has no bound

    def __init__(self, bonus):
        self.bonus = bonus

    def start(self):
        return (), None, 0.0, 0.0

    def grow(self, state, label: int):
        return (*state[0], label), None, state[2] + self.bonus(state[0], label), 0.0

    def finish(self, state) -> float:
        return state[2]


def beam_search(logs: np.ndarray, pad: int = 0, width: int = 16, bonus: Callable[[tuple, int], float] | None = None, prune: float | None = None, token: float | None = None) -> list[tuple[tuple, float]]:
    """The ``width`` likeliest label sequences of frames of log probabilities and their scores, best first, as ``readings`` finds them."""
    return [x[:2] for x in readings(logs, pad, width, LabelScorer(bonus) if bonus else None, prune, token)]


def readings(logs: np.ndarray, pad: int = 0, width: int = 16, scorer: WordScorer | LabelScorer | None = None, prune: float | None = None, token: float | None = None) -> list[tuple[tuple, float, float, tuple]]:
    """(labels, score, frames' part of it, frames at which the prefixes that end in each label came into the beam) of the ``width`` best readings of frames of log probabilities, best first.

    Frames collapse as in a greedy reading: runs of a label are one, pads fall away. The frames' part of a reading is the log of the sum over all frame paths
    that collapse to it, as far as the beam holds their prefixes. Labels under ``token`` in a frame, but for its best, are left out; prefixes that are worse than the best by more
    than ``-prune`` are dropped. With a ``WordScorer`` delimiters at the ends and next to each other fall away, so
    readings with the same words are one. All prefixes of a frame grow at once, as arrays; only those that can stay are looked at one by one.
    """
    low, mark = -np.inf, -1 if scorer is None else scorer.delimiter
    parents, labels = [-1], [mark]
    # how a prefix of the beam came into it: the step of the one it grew from, and the frame
    came = [(-1, -1)]
    trace = np.zeros(1, np.int64)
    states = [scorer.start() if scorer else None]
    children: dict[tuple[int, int], int] = {}
    ids, blank, last_p = np.zeros(1, np.int64), np.zeros(1), np.full(1, low)
    last, done, ahead = np.full(1, mark), np.zeros(1), np.zeros(1)
    n_labels = logs.shape[1]
    for t, frame in enumerate(logs):
        usable = np.ones(n_labels, bool) if token is None else frame >= token
        usable[frame.argmax()] = True
        shown = np.where(usable, frame, low)
        usable[pad] = False
        ks = np.flatnonzero(usable)
        column = np.full(n_labels + 1, -1)
        column[ks] = np.arange(len(ks))
        total = np.logaddexp(blank, last_p)
        stay = np.where(last >= 0, shown[last], low)
        at_mark = (last == mark) & (mark >= 0)
        new_blank, new_last = total + shown[pad], np.where(at_mark, total, last_p) + stay
        grown = total[:, None] + shown[ks]
        own = np.flatnonzero((last >= 0) & (column[last] >= 0))
        grown[own, column[last[own]]] = np.where(at_mark[own], low, blank[own] + shown[last[own]])
        # a prefix of the beam that grows into another one of it
        place = {p: i for i, p in enumerate(ids.tolist())}
        for c, p in enumerate(ids.tolist()):
            i = place.get(parents[p], -1)
            k = column[labels[p]] if i >= 0 else -1
            if k >= 0:
                new_last[c] = np.logaddexp(new_last[c], grown[i, k])
                grown[i, k] = low
        new_total = np.logaddexp(new_blank, new_last)
        rank = new_total + done + ahead
        # nothing that grows can come above this
        reach = grown + (done + ahead)[:, None] + (scorer.most if scorer and mark < 0 else 0.0)
        if mark >= 0 and column[mark] >= 0:
            reach[:, column[mark]] = grown[:, column[mark]] + done + scorer.most
        cut = low if prune is None else rank.max() + prune
        cut = max(cut, rank.min()) if len(ids) >= width else cut
        b, k = np.nonzero((reach >= cut) & (grown > low))
        found_ids = np.empty(len(b), np.int64)
        extra = np.zeros((2, len(b)))
        for x, (i, label) in enumerate(zip(ids[b].tolist(), ks[k].tolist(), strict=True)):
            child = children.get((i, label))
            if child is None:
                child = children[i, label] = len(parents)
                parents.append(i)
                labels.append(label)
                states.append(scorer.grow(states[i], label) if scorer else None)
            found_ids[x] = child
            if scorer:
                extra[:, x] = states[child][2:]
        ids, blank, last_p = np.concatenate([ids, found_ids]), np.concatenate([new_blank, np.full(len(b), low)]), np.concatenate([new_last, grown[b, k]])
        last, done, ahead = np.concatenate([last, ks[k]]), np.concatenate([done, extra[0]]), np.concatenate([ahead, extra[1]])
        rank = np.concatenate([rank, grown[b, k] + extra[0] + extra[1]])
        order = np.lexsort((ids, -rank))[:width]
        order = order[rank[order] > (low if prune is None else np.nextafter(rank[order[0]] + prune, low))]
        old = len(trace)
        new = order[order >= old] - old
        came += [(x, t) for x in trace[b[new]].tolist()]
        steps = np.full(len(b), -1)
        steps[new] = np.arange(len(came) - len(new), len(came))
        trace = np.concatenate([trace, steps])[order]
        ids, blank, last_p, last, done, ahead = (v[order] for v in (ids, blank, last_p, last, done, ahead))
    found: dict[tuple, list] = {}
    for i, step, total in zip(ids.tolist(), trace.tolist(), np.logaddexp(blank, last_p).tolist(), strict=True):
        path, frames, end = [], [], i
        while i > 0:
            path.append(labels[i])
            frames.append(came[step][1])
            i, step = parents[i], came[step][0]
        path, frames = path[::-1], frames[::-1]
        if mark >= 0 and path and path[-1] == mark:
            path, frames, end = path[:-1], frames[:-1], parents[end]
        # of two prefixes with the same words the better one, which comes first, tells the frames
        best = found.setdefault(tuple(path), [-np.inf, end, tuple(frames)])
        best[0] = float(np.logaddexp(best[0], total))
    out = [(k, v + (scorer.finish(states[i]) if scorer else 0.0), v, f) for k, (v, i, f) in found.items()]
    return sorted(out, key=lambda x: (-x[1], x[0]))


def _logs(rows, at: str, scores: str, labels: int | None = None) -> np.ndarray:
    return log_softmax(np.stack(rows.sort_values(at)[scores].to_list()).astype(np.float64)[:, :labels])


def decoded_labels(frames: DataFrame, key: str, at: str = "t", scores: str = "scores", pad: int = 0, width: int = 16, bonus: Callable[[tuple, int], float] | None = None, prune: float | None = None, token: float | None = None) -> DataFrame:
    """(key, labels, score): the likeliest label sequence of the frames of each key (one segment each) and its log probability. Frames without scores are left out."""
    kind = frames.schema[key].dataType.simpleString()

    def run(k, rows):
        import pandas as pd

        found, score = beam_search(_logs(rows, at, scores), pad, width, bonus, prune, token)[0]
        return pd.DataFrame([(k[0], list(map(int, found)), score)], columns=[key, "labels", "score"])

    return frames.select(key, at, scores).filter(F.col(scores).isNotNull()).groupBy(key).applyInPandas(run, f"{key} {kind}, labels array<int>, score double")


def lexicon_trie(words: DataFrame, word: str = "word") -> Lookup:
    """The beginnings of all words, as nodes of a prefix trie that tasks look up: (whether it is a word)."""
    parts = words.select(F.col(word).alias("w")).filter("w <> ''").distinct().select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("n"))
    nodes = parts.select(F.substring("w", F.lit(1), F.col("n")).alias("part"), (F.col("n") == F.length("w")).alias("is_word"))
    return Lookup.of(nodes.groupBy("part").agg(F.max("is_word").alias("is_word")), "part", ["is_word"])


def decoded_words(
    frames: DataFrame, key: str, alphabet: list[str], lexicon: DataFrame, model: DataFrame, order: int = 3, alpha: float = 0.5, beta: float = 1.5, unknown: float = -10.0,
    width: int = 100, prune: float = -10.0, token: float = -5.0, at: str = "t", scores: str = "scores", pad: int = 0,
) -> DataFrame:
    """(key, text, words: array<struct<word, beg, end>>, acoustic_score, lm_score): the best reading of the frames of each key (one segment each) as words.

    ``alphabet``: the character of each of the first components of the scores; a space divides words, '' stands for the pad. ``lexicon``: (word); ``model``: a back-off model
    (``language_model``). A word lasts from the frame at which its first label entered to the one at which its last did. Lexicon and model are files that tasks read what they need of, so neither is
    bounded by a worker's memory.
    """
    kind = frames.schema[key].dataType.simpleString()
    trie, grams = lexicon_trie(lexicon), Lookup.of(model, "gram", ["logp", "backoff"])

    def run(k, rows):
        import pandas as pd

        scorer = WordScorer(alphabet, trie.get, grams.get, order, alpha, beta, unknown)
        found, score, acoustic, entered = readings(_logs(rows, at, scores, len(alphabet)), pad, width, scorer, prune, token)[0]
        words, part = [], []
        for label, frame in [*zip(found, entered, strict=True), (scorer.delimiter, -1)]:
            if label != scorer.delimiter:
                part.append((alphabet[label], frame))
            elif part:
                words.append({"word": "".join(c for c, _ in part), "beg": part[0][1], "end": part[-1][1] + 1})
                part = []
        return pd.DataFrame([(k[0], " ".join(w["word"] for w in words), words, acoustic, score - acoustic)], columns=[key, "text", "words", "acoustic_score", "lm_score"])

    found = f"{key} {kind}, text string, words array<struct<word:string,beg:int,end:int>>, acoustic_score double, lm_score double"
    return frames.select(key, at, scores).filter(F.col(scores).isNotNull()).groupBy(key).applyInPandas(run, found)

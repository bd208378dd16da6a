"""Language identification by cross-parsing entropy.

A suffix automaton is built for every language over a bounded sample of labelled text. A document is parsed into
phrases: the longest match in the sample, again and again; a byte that the sample lacks is a phrase of its own.
Phrases times log2 of the sample's length estimate the cross entropy; the smallest wins. Texts are lower-cased, every
character that is no letter counts as one kind of gap, and what is parsed are the bytes of UTF-8, so all scripts are
covered whole and no alphabet is chosen.

Bounds of the sample (parameters): `size` characters over all languages, shared equally, of the `docs` documents of each
language with the smallest hashed ids; short documents leave their share to the language's others. More than
MAX_LANGUAGES labels raise ValueError, none is left out silently. Documents are parsed whole, in lanes of LANE bytes; a
lane starts a new phrase.

Ties go to the language that sorts first. Null texts and texts without a letter are `und`, score 0. With no labelled text
everything is `und`. Score: 1 - best / second best, 1 where only one language is known. Equal texts get equal results,
whatever their ids (null ids too, which count as one id when the sample is drawn). Rows equal in id, language and text
are drawn once. Other columns of a table stay; where one has an output's name, the output's name ends in underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_CHARS = 200_000
DOCS_A_LANGUAGE = 48
MAX_LANGUAGES = 1000
LANE = 2048
GROUP_BYTES = 3_000_000
GAP = 32


def sample(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs: int = DOCS_A_LANGUAGE, size: int = SAMPLE_CHARS
) -> dict[str, str]:
    """Language to sample. Documents are chosen without their texts, from 64 parts first so that no language meets in one
    task; only the texts chosen are read."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.trim(text) != ""))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.col(key)).alias("h"), F.xxhash64(F.col(text)).alias("th"))
    slim = rows.select("lang", "h", "th").withColumn("part", F.pmod("h", F.lit(64)))
    for by in (["lang", "part"], ["lang"]):
        slim = slim.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "th"))).filter(F.col("r") <= docs).drop("r")
    chosen = common.materialize(slim.select("lang", "h", "th").distinct())
    names = chosen.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if names > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = size // max(1, names)
    found = rows.join(F.broadcast(chosen), ["lang", "h", "th"]).select("lang", "h", "th", F.substring("t", 1, share).alias("t")).distinct()
    texts: dict[str, list[tuple]] = {}
    for r in found.collect():
        texts.setdefault(r["lang"], []).append((len(r["t"]), r["h"], r["th"], r["t"]))
    out = {}
    for name, parts in texts.items():
        left, drawn = share, []
        for k, (n, *_, t) in enumerate(sorted(parts)):  # the shortest first: what they leave goes to the others
            own = t[: min(n, max(1, left // (len(parts) - k)))]
            left -= len(own)
            drawn.append(own)
        out[name] = " ".join(drawn)
    return out


def suffix_automaton(codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (from, code, to) of the automaton of all substrings; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = copy
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
        last = now
    flat = [(s, c, t) for s, own in enumerate(edges) for c, t in own.items()]
    a = np.array(flat, dtype=np.int32).reshape(-1, 3)
    return a[:, 0].copy(), a[:, 1].astype(np.uint8), a[:, 2].copy()


class Speller:
    """Texts as the bytes that are parsed: lower-case letters in UTF-8, a gap for every other character."""

    def __init__(self) -> None:
        self.plain = bytes(c if chr(c).isalpha() and c < 128 else GAP for c in range(256))
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)

    def __call__(self, text: str) -> bytes:
        text = text.lower()
        if text.isascii():
            return text.encode().translate(self.plain)
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        return np.where(self.letter[points], points, GAP).astype("<u4").tobytes().decode("utf-32-le").encode()


def fit(samples: dict[str, str]) -> dict:
    """The model: transitions by language. Its size follows the bound of the samples."""
    names, speller = sorted(samples), Speller()
    spelled = [speller(samples[n]) for n in names]
    return {"names": names, "parts": [suffix_automaton(s) for s in spelled], "sizes": [max(2, len(s)) for s in spelled]}


class Parser:
    """The automata as one array: a state is the place of its row, a row holds the next state by code, 0 where there is
    none. Codes number the bytes of a language's sample; code 0 is every other byte."""

    def __init__(self, model: dict) -> None:
        self.names, self.spell = model["names"], Speller()
        self.codes = np.zeros((len(self.names), 256), dtype=np.int32)
        used = [np.unique(c) for _, c, _ in model["parts"]]
        states = [int(t.max(initial=0)) + 1 for _, _, t in model["parts"]]
        roots = np.cumsum([1, *(n * (len(u) + 1) for n, u in zip(states, used, strict=True))])
        self.next, roots = np.zeros(roots[-1], dtype=np.int32), roots[:-1].tolist()
        for k, (s, c, t) in enumerate(model["parts"]):
            width = len(used[k]) + 1
            self.codes[k, used[k]] = np.arange(1, width)
            self.next[s * width + self.codes[k, c] + roots[k]] = t * width + roots[k]
        self.root = np.array(roots, dtype=np.int32).reshape(-1, 1)
        first = self.next[self.root + self.codes] if roots else np.zeros((0, 256), dtype=np.int32)
        self.unseen = (first == 0).astype(np.int32)
        self.start = np.where(first == 0, self.root, first) if roots else first
        self.cost = np.log2(np.array(model["sizes"], dtype=np.float64))

    def phrases(self, lanes: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each lane (a column) under each language (a row)."""
        order = np.argsort([-len(x) for x in lanes], kind="stable")
        sizes = np.array([len(lanes[i]) for i in order])
        most = int(sizes[0]) if len(sizes) else 0
        grid = np.zeros((len(lanes), most), dtype=np.uint8)
        for k, i in enumerate(order):
            grid[k, : len(lanes[i])] = lanes[i]
        grid = np.ascontiguousarray(grid.T)
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, most + 1), side="left")
        state = np.repeat(self.root, len(lanes), axis=1)
        count = np.zeros((len(self.names), len(lanes)), dtype=np.int32)
        for t in range(most):
            k = active[t]
            c = grid[t, :k]
            s = state[:, :k]
            to = self.next.take(s + self.codes.take(c, axis=1))
            miss = to == 0
            count[:, :k] += miss & (s != self.root)
            count[:, :k] += self.unseen.take(c, axis=1)
            state[:, :k] = np.where(miss, self.start.take(c, axis=1), to)
        count += state != self.root
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        coded = [np.frombuffer(self.spell(t), dtype=np.uint8) for t in texts]
        lanes = [c[a : a + LANE] for c in coded for a in range(0, len(c), LANE)]
        owner = np.repeat(np.arange(len(coded)), [-(-len(c) // LANE) for c in coded])
        if not lanes or not self.names:
            return [("und", 0.0)] * len(texts)
        total = np.zeros((len(self.names), len(texts)))
        np.add.at(total, (slice(None), owner), self.phrases(lanes))
        cost = total * self.cost[:, None]
        best = np.argmin(cost, axis=0)
        low = np.sort(cost, axis=0)
        out = []
        for i, c in enumerate(coded):
            if not len(c) or bool((c == GAP).all()):
                out.append(("und", 0.0))
            elif len(self.names) == 1:
                out.append((self.names[0], 1.0))
            else:
                out.append((self.names[best[i]], float(1 - low[0, i] / low[1, i]) if low[1, i] else 0.0))
        return out


def identify(df: DataFrame, model: dict, text: str = "text", out: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """df with the predicted language and its score as last columns."""
    out, score = common.free_names(df, out, score)
    own = common.with_last(df, text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for batch in batches:
            for at, n in common.row_groups(batch.column(batch.num_columns - 1), GROUP_BYTES):
                rows = batch.slice(at, n)
                found = parser.predict([t or "" for t in rows.column(rows.num_columns - 1).to_pylist()])
                arrays = [*rows.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, out, score])

    return common.as_before(common.map_batches(own, run, f"{common.ddl(own)}, `{out}` string, `{score}` double"), df, out, score)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", common.row_bucket("doc_id", 5) == 0)
    model = fit(sample(docs.filter(~F.col("held_out"))))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))

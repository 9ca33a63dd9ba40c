"""Secret scan: exact base patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as begin, inside or outside of a secret. A token's scores come from its
own shape, from the shapes and words of three tokens before and one behind it, and from
features of its file; Viterbi's algorithm finds the best tags of a whole text. Scores of
distinct tokens are kept, so a text is a few table look-ups per token. Where a token is
outside on every best path, whatever its neighbours are, the path is cut: only what lies
between such tokens goes through the recursion, with the same result.

The field is trained here, on windows of a bounded sample of documents. What the base patterns
match in them is secret. Further windows get secrets of other common formats put in, with
and without words that announce them, and things that look alike but are none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.llm import secret_examples as examples

#: Sampled documents that training reads, and windows taken of each: around secrets, other tokens with digits, anywhere.
TRAIN_ROWS, WINDOWS = 1500, (2, 1, 1)
#: Tokens of a window to each side of its centre.
REACH = 12
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
TOKEN = re.compile(r"[\w+/.\-@]+|[^\w\s+/.\-@]+")
#: Tags: outside, begin, inside.
OUT, BEGIN, INSIDE = range(3)
#: Places of neighbours whose features count.
PLACES = (-3, -2, -1, 1)
PAD = 3
LEADS = ("AKIA", "ASIA", "AIza", "eyJ", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "sk-", "xoxb-", "xoxp-")
LENGTHS = (1, 3, 7, 11, 15, 19, 31, 39, 63)
#: Score that a secret must have above the best reading without it.
CAUTION = 1.0
#: Bound of learned transitions, tokens whose scores a task keeps, tokens and texts scored together.
STEEP, KNOWN, TOGETHER, PIECE, BATCH = 8.0, 150_000, 1 << 17, 1 << 16, 256
WORD_COUNT, MOST_WORDS, REFINE = 3, 400, 3
SEED = 13
WHITE = " \t\n\r\x0b\x0c"


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, secret start, secret end) of the base patterns, by start, then kind."""
    found = []
    lowered = text.lower()
    if any(c in lowered for c in CUES):
        found += [(*m.span(), *m.span(2), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(*m.span(), *m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(*m.span(), *m.span(), 2) for m in HEX.finditer(text)]
    return sorted((start, kind, end, a, b) for start, end, a, b, kind in found)


def length_class(n: int) -> int:
    return next((k for k, most in enumerate(LENGTHS) if n <= most), len(LENGTHS))


def describe(token: str) -> tuple[str, int, int, str]:
    """Form, class of length, class of changes between letters and digits, and known lead of a token."""
    word = token.rstrip(".")
    n = length_class(len(word))
    if word.isalpha():
        form = "lower" if word.islower() else "title" if word[1:].islower() else "upper" if word.isupper() else "mixed"
        return form, n, 0, ""
    lead = next((p for p in LEADS if word.startswith(p)), "")
    kinds = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in word]
    have = set(kinds)
    signs = have - {"0", "a", "A"}
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    if not have & {"0", "a", "A"}:
        return "sign" + word[:3], n, 0, ""
    if "@" in signs:
        form = "mail"
    elif have <= {"0", ".", "-", "+", "/"}:
        form = "number"
    elif "/" in signs and "." in signs and word.count("/") + word.count(".") >= 2:
        form = "path"
    elif all(c in "0123456789abcdef" for c in word):
        form = "hex"
    else:
        form = "".join(sorted(have & {"0", "a", "A"})) + ("" if not signs else "_" if signs <= {"_", "-"} else "/" if signs <= {"+", "/", "-", "_"} else ".")
    return form, n, min(4, 8 * changes // max(1, len(word))), lead


def own_features(token: str) -> list[str]:
    form, n, changes, lead = describe(token)
    return ["any", f"form {form}", f"length {n}", f"both {form} {n}", f"turns {form} {changes}", f"lead {lead}"]


def neighbour_features(place: int, token: str, words) -> list[str]:
    """Features of the token at a place next to the tagged one; its word only if it is one of `words`."""
    form, n, _, _ = describe(token)
    word = token.rstrip(".").lower()
    return [f"{place} form {form}", f"{place} size {n // 3}", *([f"{place} word {word}"] if word in words else [])]


def share_class(part: float, whole: float) -> int:
    return 0 if not part else 1 if part < 0.02 * whole else 2 if part < 0.1 * whole else 3


def file_features(text: str, tokens: int, digits: float, code: float) -> tuple[str, str, str]:
    """Features of a file: its shares of tokens with digits and of code signs, and its mean line length."""
    lines = text.count("\n") + 1
    return (
        f"file digits {share_class(digits, tokens)}", f"file code {share_class(code, tokens)}",
        f"file lines {length_class(len(text) // (4 * lines))}",
    )


def flags(token: str) -> tuple[bool, bool]:
    """Has a digit; is a sign of code."""
    return any(map(str.isdigit, token)), not token[:1].isalnum() and any(c in "{}[]()=;<>|&" for c in token)


def windows(text: str, seed: int) -> list[tuple[list[str], list[int], list[str]]]:
    """Tokens, tags and file features of some stretches of a text: around secrets of the base patterns, around
    other tokens with digits, and anywhere."""
    spans = [(a, b) for _, _, _, a, b in base_spans(text)]
    found = list(TOKEN.finditer(text))
    tags = np.zeros(len(found), np.int64)
    starts = np.array([m.start() for m in found], np.int64)
    for a, b in spans:
        inside = np.arange(*np.searchsorted(starts, (a, b)))
        tags[inside] = np.where(np.arange(len(inside)) == 0, BEGIN, INSIDE)
    marks = np.array([flags(m.group()) for m in found], bool).reshape(-1, 2)
    file = list(file_features(text, len(found), *marks.sum(axis=0)))
    rng = np.random.default_rng(seed)
    odd = np.flatnonzero(marks[:, 0] & (tags == OUT))
    centres: list[int] = []
    for pool, n in zip((np.flatnonzero(tags == BEGIN), odd, np.arange(len(found))), WINDOWS):
        centres += rng.permutation(pool)[:n].tolist()
    out = []
    for c in centres:
        a, b = max(0, c - REACH), min(len(found), c + REACH)
        out.append(([found[k].group() for k in range(a, b)], tags[a:b].tolist(), file))
    return out


def training_windows(df: DataFrame, id_col: str, text_col: str, rows: int) -> list[tuple[list[str], list[int], list[str]]]:
    """Windows of about `rows` documents, chosen by a hash of the id."""
    rows_all = df.count()
    h = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(1 << 30))
    chosen = df.filter(h < min(1.0, rows / max(rows_all, 1)) * (1 << 30)).filter(F.col(text_col).isNotNull())
    # rows that repeat an id share its hash: the bound is kept by number, too
    chosen = chosen.select(h.alias("h"), F.col(text_col).alias("t")).limit(2 * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                made = windows(t.as_py(), h)
                columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)] if made else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(made), pa.int64()), *columns], names=["h", "tokens", "tags", "file"])

    kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
    made = chosen.mapInArrow(run, "h bigint, tokens array<string>, tags array<int>, file array<string>").collect()
    return [(list(r.tokens), list(r.tags), list(r.file)) for r in sorted(made, key=lambda r: (r.h, r.tokens, r.tags))]


class Field:
    """Weights of features for begin and inside, relative to outside, and transitions between tags."""

    def __init__(self, weight: dict[str, tuple[float, float]], step: np.ndarray, words: frozenset[str]):
        self.weight, self.step, self.words = weight, step, words

    def score(self, names) -> np.ndarray:
        return np.array([self.weight.get(n, (0.0, 0.0)) for n in names]).sum(axis=0)

    def parts(self) -> tuple:
        """What a task needs to build the field again."""
        return self.weight, self.step, self.words


def train(sample: list, rounds: int = 10, rate: float = 0.3, decay: float = 1e-4, seed: int = SEED) -> Field:
    """Fit a field by gradient steps on the likelihood of the windows' tags, several windows at a time."""
    from collections import Counter

    near = Counter()
    for tokens, tags, _ in sample:
        for t in np.flatnonzero(np.array(tags) == BEGIN).tolist():
            near.update({tokens[t + p].rstrip(".").lower() for p in PLACES if 0 <= t + p < len(tokens)})
    words = frozenset(w for w, n in near.most_common(MOST_WORDS) if n >= WORD_COUNT and len(w) <= 24 and not any(map(str.isdigit, w)))
    number: dict[str, int] = {}
    made = []
    for tokens, tags, file in sample:
        own = [own_features(t) for t in tokens]
        side = {p: [neighbour_features(p, t, words) for t in tokens] for p in PLACES}
        rows = []
        for t in range(len(tokens)):
            names = [*own[t], *file]
            for p in PLACES:
                if 0 <= t + p < len(tokens):
                    names += side[p][t + p]
            rows.append([number.setdefault(n, len(number) + 1) for n in names])
        made.append((rows, tags))
    weight, step = np.zeros((len(number) + 1, 2)), np.zeros((3, 3))
    step[OUT, INSIDE] = -STEEP
    seen_w, seen_s = np.full_like(weight, 1e-2), np.full_like(step, 1e-2)
    most = max((len(r) for rows, _ in made for r in rows), default=1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(made))
        for at in range(0, len(order), 64):
            part = [made[k] for k in order[at : at + 64]]
            longest = max(len(tags) for _, tags in part)
            ids = np.zeros((len(part), longest, most), np.int64)
            real, gold = np.zeros((len(part), longest), bool), np.zeros((len(part), longest), np.int64)
            for i, (rows, tags) in enumerate(part):
                real[i, : len(tags)], gold[i, : len(tags)] = True, tags
                for t, r in enumerate(rows):
                    ids[i, t, : len(r)] = r
            e = np.zeros((len(part), longest, 3))
            e[:, :, 1:] = weight[ids].sum(axis=2)
            e[~real] = (0.0, -1e4, -1e4)
            node, edge = marginals(e, step)
            node[np.arange(len(part))[:, None], np.arange(longest), gold] -= 1
            full = np.concatenate([np.zeros((len(part), 1), np.int64), gold, np.zeros((len(part), 1), np.int64)], axis=1)
            np.add.at(edge, (full[:, :-1], full[:, 1:]), -1.0)
            grad = np.repeat((node[:, :, 1:] * real[:, :, None])[:, :, None, :], most, axis=2).reshape(-1, 2)
            down = np.stack([np.bincount(ids.ravel(), g, len(weight)) for g in grad.T], axis=1)
            down = down / len(part) + decay * weight
            down[0] = 0
            seen_w += down * down
            weight -= rate * down / np.sqrt(seen_w)
            edge = edge / len(part) + decay * step
            seen_s += edge * edge
            step = np.clip(step - rate * edge / np.sqrt(seen_s), -STEEP, STEEP)
            weight[0] = 0
    kept = {n: (float(weight[k, 0]), float(weight[k, 1])) for n, k in number.items()}
    return Field(kept, step, words)


def marginals(e: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities of each token, and expected transitions, by the forward-backward recursion in logs.

    Texts start and end outside.
    """
    def total(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    n, size, _ = e.shape
    ahead, back = np.zeros_like(e), np.zeros_like(e)
    ahead[:, 0] = step[OUT] + e[:, 0]
    for t in range(1, size):
        ahead[:, t] = total(ahead[:, t - 1, :, None] + step, 1) + e[:, t]
    back[:, -1] = step[:, OUT]
    for t in range(size - 2, -1, -1):
        back[:, t] = total(step + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    whole = total(ahead[:, -1] + back[:, -1], 1)
    node = np.exp(ahead + back - whole[:, None, None])
    pairs = ahead[:, :-1, :, None] + step + (e[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    edge = np.exp(pairs).sum(axis=(0, 1))
    edge[OUT] += node[:, 0].sum(axis=0)
    edge[:, OUT] += node[:, -1].sum(axis=0)
    return node, edge


def viterbi(e: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of stretches laid end to end; `first` are their starts and the end. All stretches step together.

    `e` holds scores of begin and inside relative to outside; before and behind a stretch is outside.
    """
    tags = np.zeros(len(e), np.int8)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    if not len(size):
        return tags
    came = np.zeros((len(e), 3), np.int8)
    ends = np.zeros((len(start), 3))
    now = np.zeros((0, 3))
    for t in range(int(size[0])):
        n = int(np.searchsorted(-size, -t, "left"))  # stretches longer than t
        at = start[:n] + t
        full = np.concatenate([np.zeros((n, 1)), e[at]], axis=1)
        if t:
            paths = now[:n, :, None] + step
            came[at] = paths.argmax(axis=1)
            now = paths.max(axis=1) + full
        else:
            now = step[OUT] + full
        done = size[:n] == t + 1
        ends[:n][done] = now[done]
    tag = (ends + step[:, OUT]).argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, "left"))
        at = start[:n] + t
        inner = size[:n] > t + 1
        tag[:n][inner] = came[at[inner] + 1, tag[:n][inner]]
        tags[at] = tag[:n]
    return tags


def surely_outside(e: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tokens that no best path tags begin or inside; `first` are the starts of the texts, and the end.

    Bounds what the best path to a token, and from it on, can gain by tagging it: first whatever
    stands next to it, then given the same bounds of its neighbours, REFINE times.
    """
    starts, ends = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    base = step[OUT, OUT]
    ahead = e + (step[:, 1:] - step[:, :1]).max(axis=0)
    behind = np.tile((step[1:] - step[:1]).max(axis=1), (len(e), 1))
    for _ in range(REFINE):
        before, after = np.roll(ahead, 1, axis=0), np.roll(e + behind, -1, axis=0)
        before[starts], after[ends] = -np.inf, -np.inf
        new_ahead, new_behind = np.zeros_like(ahead), np.zeros_like(behind)
        for k, tag in enumerate((BEGIN, INSIDE)):
            ways = [np.minimum(before[:, j] + step[a, tag] - base, step[a, tag] - step[a, OUT]) for j, a in enumerate((BEGIN, INSIDE))]
            new_ahead[:, k] = e[:, k] + np.maximum(step[OUT, tag] - base, np.maximum(*ways))
            ways = [np.minimum(after[:, j] + step[tag, b] - base, step[tag, b] - step[OUT, b]) for j, b in enumerate((BEGIN, INSIDE))]
            new_behind[:, k] = np.maximum(step[tag, OUT] - base, np.maximum(*ways))
        ahead, behind = new_ahead, new_behind
    return (ahead + behind < 0).all(axis=1)


class Scores(dict):
    """Rows of `table` for tokens: scores as the tagged token and at each of PLACES beside it, then flags. Row 0 is none."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        self.table = np.zeros((KNOWN + 1, 2 * (1 + len(PLACES)) + 2))
        self.shapes: dict[tuple, np.ndarray] = {}

    def __missing__(self, token: str) -> int:
        row = len(self) + 1
        word = token.rstrip(".").lower()
        key = (*describe(token), word if word in self.field.words else None)
        found = self.shapes.get(key)
        if found is None:
            f = self.field
            parts = [f.score(own_features(token)), *(f.score(neighbour_features(p, token, f.words)) for p in PLACES)]
            found = self.shapes[key] = np.concatenate(parts)
        self.table[row, : len(found)] = found
        self.table[row, len(found) :] = flags(token)
        self[token] = row
        return row

    def rows(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


class Scanner:
    """Tags whole texts with a field."""

    def __init__(self, field: Field, caution: float = CAUTION):
        self.field, self.caution = field, caution
        self.scores = Scores(field)

    def emissions(self, text: str, tokens: list[str]) -> np.ndarray:
        """Scores of begin and inside relative to outside for every token, a piece at a time."""
        out = np.zeros((len(tokens), 2))
        digits = code = 0.0
        width = 2 * (1 + len(PLACES))
        for at in range(0, len(tokens), PIECE):
            a, b = max(0, at - PAD), min(len(tokens), at + PIECE + 1)
            if len(self.scores) + b - a > KNOWN:
                self.scores.clear()
            got = np.zeros((PAD + b - a + 1, width + 2))
            got[PAD - (at - a) : PAD - (at - a) + b - a] = self.scores.table[self.scores.rows(tokens[a:b])]
            n = min(PIECE, len(tokens) - at)
            out[at : at + n] = got[PAD : PAD + n, :2]
            for k, p in enumerate(PLACES, 1):
                out[at : at + n] += got[PAD + p : PAD + p + n, 2 * k : 2 * k + 2]
            digits, code = digits + got[PAD : PAD + n, width].sum(), code + got[PAD : PAD + n, width + 1].sum()
        out += self.field.score(file_features(text, len(tokens), digits, code))
        out[:, 0] -= self.caution
        return out

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """Best tags of the tokens of every text."""
        scored = [self.emissions(t, TOKEN.findall(t)) for t in texts]
        first = np.r_[0, np.cumsum([len(s) for s in scored])].astype(np.int64)
        e = np.concatenate([np.zeros((0, 2)), *scored])
        sure = surely_outside(e, self.field.step, first)
        tags = np.zeros(len(e), np.int8)
        left = np.flatnonzero(~sure)
        if len(left):
            text = np.searchsorted(first, left, "right")
            cut = np.r_[0, np.flatnonzero((np.diff(left) > 1) | (np.diff(text) > 0)) + 1, len(left)]
            tags[left] = viterbi(e[left], cut, self.field.step)
        return [tags[a:b] for a, b in zip(first, first[1:])]

    def spans(self, text: str, tags: np.ndarray) -> list[tuple[int, int]]:
        """Code points of the tagged secrets; a full stop at the end of a sentence is none of theirs."""
        marked = set(np.flatnonzero(tags).tolist())
        out: list[list[int]] = []
        last = -2
        for k, m in enumerate(TOKEN.finditer(text)) if marked else ():
            if k in marked:
                if tags[k] == BEGIN or last != k - 1:
                    out.append([m.start(), m.end()])
                else:
                    out[-1][1] = m.end()
                last = k
        return [(a, a + len(text[a:b].rstrip("."))) for a, b in out]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Field:
    """A field trained on windows of about `rows` documents and on examples put into them."""
    return train(examples.widened(training_windows(df, id_col, text_col, rows), SEED))


def scan(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    spans lists kind:start:end of all secrets by start, then kind (assign, access, hex, crf), in
    code points, end exclusive. The base patterns are taken leftmost, without overlap within a
    kind; base_sha256 covers them alone. Spans of the field that touch none of them are added.

    Whole texts are read; rows are not moved. Null and empty texts have no spans; repeated rows
    get equal results; other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(field.parts())
    kind = df.schema[id_col].dataType.simpleString()
    kinds = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Field(*shared.value))

        def result(text: str, tags: np.ndarray) -> tuple:
            base = [(start, kind, end) for start, kind, end, _, _ in base_spans(text)]
            added = [
                (a, len(KINDS) - 1, b) for a, b in scanner.spans(text, tags) if not any(a < end and start < b for start, _, end in base)
            ]
            counts = [sum(k == want for _, k, _ in base) for want in range(3)]
            digest = hashlib.sha256(shown(base).encode()).hexdigest()
            return *counts, digest, shown(sorted(base + added)), len(added)

        def out(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            columns = list(zip(*map(result, texts, scanner.tags(texts))))
            arrays = [pa.array(c, pa.string() if k in (3, 4) else pa.int64()) for k, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays([ids, *arrays], names=names)

        for batch in batches:
            texts, size, at = [], 0, 0
            for k in range(batch.num_rows):
                texts.append(batch.column(1)[k].as_py() or "")
                size += len(texts[-1]) // 4
                if size >= TOGETHER or len(texts) >= BATCH:
                    yield out(batch.column(0).slice(at, len(texts)), texts)
                    texts, size, at = [], 0, k + 1
            if texts:
                yield out(batch.column(0).slice(at, len(texts)), texts)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, kinds)

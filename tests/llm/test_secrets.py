"""Secret scan: base patterns one by one, Viterbi against all taggings, accuracy on unseen examples."""

import hashlib
import re
from itertools import product

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridflow.llm import secret_examples, secret_scan
from gridflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_base(text):
    out = []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


@pytest.fixture(scope="module")
def field(spark):
    return secret_scan.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_base_of_documents(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = QUERIES["op13_secrets"](spark, SF).collect()
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_hex for r in rows) > 10
    for r in rows:
        base = plain_base(docs[r.doc_id] or "")
        kinds = [s.split(":")[0] for s in base.split(",")] if base else []
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r.spans.split(","))
    clean = [r for r in rows if not r.n_assign + r.n_access + r.n_hex]
    assert sum(r.n_added > 0 for r in clean) <= 0.002 * len(clean)


@given(st.lists(st.sampled_from(["password", "API_KEY", "apikey", "toKen", "Key", "toſecret", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "0af9" * 8, "/x.-_+", "é", "\n", "a1"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_base_of_any_text(parts):
    text = "".join(parts)
    found = secret_scan.base_spans(text)
    assert ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b, _, _ in found) == plain_base(text)


def best_tags(e, step):
    """Score of the best of all taggings, and the tagging."""
    best = (-np.inf, None)
    for tags in product(range(3), repeat=len(e)):
        full = (0, *tags, 0)
        score = sum(step[a, b] for a, b in zip(full, full[1:])) + sum(e[t][k - 1] for t, k in enumerate(tags) if k)
        best = max(best, (score, tags))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_equals_all_taggings(seed):
    rng = np.random.default_rng(seed)
    step = rng.normal(size=(3, 3)) * 2
    step[0, 2] = -secret_scan.STEEP
    sizes = rng.integers(1, 8, 12)
    e = rng.normal(size=(sizes.sum(), 2)) * 4 - 2
    first = np.r_[0, np.cumsum(sizes)]
    tags = secret_scan.viterbi(e, first, step)
    for a, b in zip(first, first[1:]):
        assert tuple(tags[a:b]) == best_tags(e[a:b], step)[1]


def test_cuts_lose_nothing(field):
    """Cutting texts at tokens that are surely outside gives the tags of the whole recursion."""
    texts = [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 40").fetchall()]
    for tokens, _, _ in secret_examples.widened([(list("abcdefgh"), [0] * 8, [])] * 150, 5):
        texts.append(" ".join(tokens))
    texts += ["", " ".join(texts), "x" * 50]
    scanner = secret_scan.Scanner(field)
    got = scanner.tags(texts)
    cut = 0
    for text, tags in zip(texts, got):
        e = scanner.emissions(text, secret_scan.TOKEN.findall(text))
        cut += secret_scan.surely_outside(e, field.step, np.array([0, len(e)])).sum()
        if len(e):
            assert tags.tolist() == secret_scan.viterbi(e, np.array([0, len(e)]), field.step).tolist()
    assert cut > 5000


def test_gradient_of_the_likelihood():
    """Marginals and expected transitions against all taggings."""
    rng = np.random.default_rng(2)
    e, step = np.concatenate([np.zeros((1, 4, 1)), rng.normal(size=(1, 4, 2))], axis=2), rng.normal(size=(3, 3))
    node, edge = secret_scan.marginals(e, step)
    want, want_edge, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for tags in product(range(3), repeat=4):
        full = (0, *tags, 0)
        p = np.exp(sum(step[a, b] for a, b in zip(full, full[1:])) + sum(e[0, t, k] for t, k in enumerate(tags)))
        total += p
        for t, k in enumerate(tags):
            want[t, k] += p
        for a, b in zip(full, full[1:]):
            want_edge[a, b] += p
    assert np.allclose(node[0], want / total) and np.allclose(edge, want_edge / total)


def test_unseen_examples(spark, field):
    """Secrets put into texts of other documents than those trained on, of the same formats with other characters."""
    docs = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id desc").fetchall()
    made = [w for (t,) in docs for w in secret_scan.windows(t, 99)]
    new = secret_examples.widened(made, 77)[len(made) :]
    scanner = secret_scan.Scanner(field)
    right = wrong = missed = 0
    for tokens, tags, _ in new:
        text, want, at = "", [], 0
        for token, tag in zip(tokens, tags):
            if tag == 1:
                want.append([len(text), len(text) + len(token)])
            elif tag == 2:
                want[-1][1] = len(text) + len(token)
            text += token + " "
        (found,) = scanner.tags([text])
        got = {a for a, _ in scanner.spans(text, found)}
        starts = {a for a, _ in want}
        right, wrong, missed = right + len(got & starts), wrong + len(got - starts), missed + len(starts - got)
    assert right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.95


def test_edges(spark, field):
    """Nulls, empty and long texts, repeats, clashing names, an empty table, a field trained on nothing."""
    key = "Zx9" + "qR7tLmP2vB8nK4" * 2
    rows = [
        (1, None), (2, ""), (None, f"the secret key is {key}."), (3, f"Authorization: Bearer {key}"), (3, f"Authorization: Bearer {key}"),
        (4, "word " * 150_000 + f'token = "{"0af9" * 10}"'), (5, "password: no"), (6, "AKIA" + "B" * 11), (7, "AKIA" + "B" * 12),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("_text", "spans", "n_hex", "base_sha256")})
    got = secret_scan.scan(docs, field).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0] == by[3][1] and by[3][0].spans == f"crf:22:{22 + len(key)}" and by[3][0].n_assign == 0
    assert by[None][0].spans == f"crf:18:{18 + len(key)}"
    assert (by[4][0].n_assign, by[4][0].n_hex) == (1, 1) and by[4][0].spans == "assign:750000:750049,hex:750009:750049"
    assert by[1][0].spans == by[2][0].spans == by[5][0].spans == "" and by[6][0].n_access == 0 and by[7][0].n_access == 1
    none = docs.limit(0)
    nothing = secret_scan.fit(none)
    assert secret_scan.scan(none, nothing).count() == 0
    assert secret_scan.scan(docs, nothing).count() == len(rows)

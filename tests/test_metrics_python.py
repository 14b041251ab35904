"""Cross-check every metric against plain Python written from the definitions (brute force,
including the LCS that has no SQL oracle) on the sf0.001 responses fixture."""

import math
import sys
import re
from collections import Counter
from functools import cache
from itertools import combinations

from conftest import SF001

from longctx.functions.lcs import lcs_length
from longctx.operators.metrics import text_metrics
from longctx.sources import fixtures as fx

sys.setrecursionlimit(20_000)
_W = re.compile(r"[^\w\s]")


def toks(s):
    s = _W.sub(" ", (s or "").lower())
    return [t for t in s.split() if t not in ("a", "an", "the")]


def grams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) if len(t) >= n else Counter()


def f1(ov, lp, lr):
    if ov == 0:
        return 0.0
    p, r = ov / lp, ov / lr
    return 2 * p * r / (p + r)


def ratio_of(ref, pred, n):
    """F1 of the n-gram multisets; without n-grams on either side, 1 only for equal token lists."""
    rg, pg = grams(ref, n), grams(pred, n)
    sizes = rg.total(), pg.total()
    return f1((rg & pg).total(), sizes[1], sizes[0]) if all(sizes) else float(not any(sizes) and ref == pred)


def smoothed_bleu(ref, pred):
    def precision(n):
        pg = grams(pred, n)
        return ((pg & grams(ref, n)).total() + 1) / (pg.total() + 1) if pg else 1e-9
    brevity = min(1.0, math.exp(1 - len(ref) / len(pred)))
    return brevity * math.prod(precision(n) for n in range(1, 5)) ** 0.25


def ref_metrics(a, b):
    r, p = toks(a), toks(b)
    names = ("exact_match", "token_f1", "rouge1_f1", "rouge2_f1", "rougeL_f1", "bleu")
    if not (r and p):
        return dict.fromkeys(names, float(r == p))
    return dict(zip(names, (float(r == p), ratio_of(r, p, 1), ratio_of(r, p, 1), ratio_of(r, p, 2),
                            f1(lcs_recursive(r, p), len(p), len(r)), smoothed_bleu(r, p))))


def lcs_by_subsets(a, b):
    """Length of the longest subsequence of ``a`` that is one of ``b``, by trying all of them, longest first."""
    def inside(sub, seq):
        rest = iter(seq)
        return all(x in rest for x in sub)
    return next(n for n in range(len(a), -1, -1) if any(inside(s, b) for s in combinations(a, n)))


def lcs_recursive(a, b):
    """Take the first token and its next place in ``b``, or leave it."""
    @cache
    def longest(i, j):
        if i == len(a) or j == len(b):
            return 0
        skip = longest(i + 1, j)
        return max(skip, 1 + longest(i + 1, b.index(a[i], j) + 1)) if a[i] in b[j:] else skip
    return longest(0, 0)


def test_bit_parallel_lcs_matches_plain_searches():
    import random
    rnd = random.Random(7)
    for _ in range(120):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        assert lcs_length(a, b) == lcs_by_subsets(a, b) == lcs_recursive(a, b)


def test_metrics_equal_python(spark):
    df = fx.responses_df(spark, SF001)
    rows = text_metrics(df, ["case_uuid", "prompt_id", "model"]).collect()
    assert rows
    bad = 0
    for r in rows:
        exp = ref_metrics(r.human_validated_answer, r.response)
        for k, v in exp.items():
            if abs(r[k] - v) > 1e-9:
                bad += 1
    assert bad == 0


def test_rowwise_equals_explode(spark):
    df = fx.responses_df(spark, SF001)
    ids = ["case_uuid", "prompt_id", "model"]
    cols = ids + ["n_ref_tokens", "n_pred_tokens", "ov_1", "ov_2", "ov_3", "ov_4", "lcs", "exact_match",
                  "token_f1", "rouge1_f1", "rouge2_f1", "rougeL_f1", "bleu"]
    a = text_metrics(df, ids, method="rowwise").select(*cols).collect()
    b = text_metrics(df, ids, method="explode").select(*cols).collect()
    assert sorted(a) == sorted(b)

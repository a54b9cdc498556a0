"""Sequence functions: error rates inside the JVM, and the small dynamic programs that need Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_edits(ref: Column, hyp: Column) -> Column:
    """Edit distance of two arrays of tokens: each distinct token becomes one character, then the built-in counts.

    Characters are those from U+10000 on, of which there are a million; so no two tokens share one.
    """
    # The tokens are a lambda's argument, so that they are found once a row and not once a token.
    number = lambda tokens: lambda t: F.lpad(F.hex(F.array_position(tokens, t) + 0xFFFF), 8, "0")
    code = lambda a, tokens: F.decode(F.unhex(F.array_join(F.transform(a, number(tokens)), "")), "UTF-32")
    edits = lambda tokens: F.levenshtein(code(ref, tokens), code(hyp, tokens))
    return F.element_at(F.transform(F.array(F.array_distinct(F.concat(ref, hyp))), edits), 1)


#: Rows of a batch that are taken out of Arrow at a time.
ROWS = 64


def _path(target: list[str], observed: list[str], edit: int, match: int) -> list[tuple[bool, bool]]:
    """The path of least cost as steps (in the target, in the observed): a diagonal step is tried first, then one in the target.

    Rows of costs are filled as arrays and dropped; of each cell two bits stay, which steps lead to it.
    """
    number: dict = {}
    t, o = ([number.setdefault(x, len(number)) for x in side] for side in (target, observed))
    o, slope = np.array(o, np.int64), edit * np.arange(len(observed) + 1, dtype=np.int64)
    d, diagonal, down = slope, [], []
    for i, x in enumerate(t, 1):
        across, below = d[:-1] + np.where(o == x, match, edit), d + edit
        row = np.concatenate([[edit * i], np.minimum(across, below[1:])])
        d = np.minimum.accumulate(row - slope) + slope
        diagonal.append(np.packbits(d[1:] == across))
        down.append(np.packbits(d == below))
    out, i, j = [], len(target), len(observed)
    while i or j:
        if i and j and diagonal[i - 1][j - 1 >> 3] >> (7 - (j - 1 & 7)) & 1:
            step = (True, True)
        else:
            step = (True, False) if i and down[i - 1][j >> 3] >> (7 - (j & 7)) & 1 else (False, True)
        i, j = i - step[0], j - step[1]
        out.append(step)
    return out[::-1]


def _steps(targets: pa.Array, observed: pa.Array, edit: int, match: int, fields: tuple[str, str, str], names: tuple[str, str, str, str]) -> pa.Array:
    """Paths as arrays of (name of the step, target, observed), built a few rows at a time. names: same, other, lost, extra."""
    same, other, lost, extra = names
    kind, parts = pa.struct([(f, pa.string()) for f in fields]), []
    for at in range(0, len(targets), ROWS):
        columns, ends = ([], [], []), [0]
        for r, h in zip(targets[at : at + ROWS].to_pylist(), observed[at : at + ROWS].to_pylist(), strict=True):
            i = j = 0
            for in_r, in_h in _path(r, h, edit, match):
                x, y = r[i] if in_r else None, h[j] if in_h else None
                i, j = i + in_r, j + in_h
                for c, v in zip(columns, ((same if x == y else other) if in_r and in_h else lost if in_r else extra, x, y), strict=True):
                    c.append(v)
            ends.append(len(columns[0]))
        values = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(kind))
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


EDITS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "target", "predicted")]))


@F.arrow_udf(EDITS)
def align(target: pa.Array, predicted: pa.Array) -> pa.Array:
    """Edit operations from target to predicted; a diagonal step is tried first, then a deletion, then an insertion."""
    return _steps(target, predicted, 1, 0, ("op", "target", "predicted"), ("match", "substitution", "deletion", "insertion"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def viterbi(scores: pd.Series, n_targets: pd.Series) -> pd.Series:
    """Monotonic path through frames (arrays of log scores of each target): stay or advance, each target at least one frame, staying on ties. Empty if there are fewer frames than targets."""

    def path(frames, n: int) -> list[int]:
        x = np.array([list(f)[:n] for f in frames], float).reshape(len(frames), -1)
        if n == 0 or len(x) < n:
            return []
        best, came = np.full(n, -np.inf), np.zeros(x.shape, bool)
        best[0] = x[0, 0]
        for t in range(1, len(x)):
            step = np.concatenate([[-np.inf], best[:-1]])
            came[t] = step > best
            best = np.where(came[t], step, best) + x[t]
        out, k = [n - 1], n - 1
        for t in range(len(x) - 1, 0, -1):
            k -= int(came[t, k])
            out.append(k)
        return out[::-1]

    return pd.Series([path(f, int(n)) for f, n in zip(scores, n_targets, strict=True)])


STATUSES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("status", "target", "observed")]))


@F.arrow_udf(STATUSES)
def assess(target: pa.Array, observed: pa.Array) -> pa.Array:
    """Status of each target and each extra token, on the path of least (cost, -matches); among equal ones a diagonal step goes
    before a missing, a missing before an extra. Cost and matches are one number, 2 ** 20 for an edit less 1 for a match."""
    return _steps(target, observed, 1 << 20, -1, ("status", "target", "observed"), ("correct", "incorrect", "missing", "extra"))

"""Cross-validation of KAPPA and Z of ``tidemark.llm.toxicity`` within the rows that are not held out.

    python -m tests.llm.choose /root/testdata/sf0.1 /root/testdata/check_s

Labelled rows whose crc32(doc_id) mod 3 is not 1 are dealt into FOLDS folds by
another hash. A model is fitted without a fold's labels and judged on them at
the threshold: the mean over tables of the F1 value decides. Held-out labels
are never read.
"""

import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import toxicity

FOLDS = 5


def fitted(training, corpus):
    """The model of (text, label, half) rows, by the operator's own steps in one process."""
    counts = {}
    n = Counter()
    for text, label, half in training:
        if half == 0:
            n[label] += 1
            for word in set(toxicity.WORD.findall(text.lower())):
                for unit in toxicity.units(word):
                    counts.setdefault(unit, [0, 0])[1 - label] += 1
    train = {u: tuple(c) for u, c in counts.items() if sum(c) >= toxicity.MIN_DOCS} | {"": (n[1], n[0])}
    model = toxicity.Model(toxicity.log_odds(train, corpus))
    seen = [(label, *model.scan(text)) for text, label, half in training if half == 1]
    clean = [r for r in seen if not r[0]]
    model.lam = toxicity.solve_lambda(Counter(round(s, 3) for r in clean for s in r[3]), sum(r[1] for r in clean))
    weight = sum(r[1] * np.exp(-model.lam * max((s for _, _, s in r[2]), default=0.0)) for r in clean)
    model.k = min(1.0, len(clean) / weight) if weight else 1.0
    x = np.array([(1.0, a / 10, b) for a, b in (model.features(r[1], r[2]) for r in seen)])
    model.curve = tuple(toxicity.logistic(x, np.array([float(r[0]) for r in seen])))
    return model


def table(path):
    docs = pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    labels = pq.read_table(f"{path}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict()
    known = {i: t for i, t in zip(labels["doc_id"], labels["toxic"], strict=True) if t is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    corpus = Counter()
    for text in docs["text"]:
        corpus[""] += 1
        corpus.update(u for word in set(toxicity.WORD.findall((text or "").lower())) for u in toxicity.units(word))
    rows = [(i, text or "", known[i]) for i, text in zip(docs["doc_id"], docs["text"], strict=True) if i in known]
    return [(zlib.crc32(f"fold {i}".encode()) % FOLDS, zlib.crc32(f"half {i}".encode()) % 2, text, t) for i, text, t in rows], corpus


def f1(rows, corpus):
    hit = Counter()
    for fold in range(FOLDS):
        model = fitted([(text, t, half) for f, half, text, t in rows if f != fold], corpus)
        for f, _, text, t in rows:
            if f == fold:
                n, found, _ = model.scan(text)
                hit[t, model.probability(model.features(n, found)) >= toxicity.THRESHOLD] += 1
    return 2 * hit[1, True] / max(2 * hit[1, True] + hit[0, True] + hit[1, False], 1)


def main():
    tables = [table(path) for path in sys.argv[1:]]
    for toxicity.KAPPA in (1.0, 2.0, 4.0, 8.0):
        for toxicity.Z in (2.0, 3.0, 4.0, 5.0):
            each = [f1(*t) for t in tables]
            print(toxicity.KAPPA, toxicity.Z, *[round(x, 4) for x in each], "mean", round(sum(each) / len(each), 4), flush=True)


if __name__ == "__main__":
    main()

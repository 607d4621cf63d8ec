"""How well labels spread over a graph of verified links between whole documents, to compare with ``subject_areas``.

``python tests/llm/document_links.py FOLDER``: TF-IDF cosines of all documents, each document linked to its nearest that reach a
cosine, labels clamped and propagated until they settle, with every fifth label hidden. Dense, so for some ten thousand documents.
"""

import re
import sys
from collections import Counter

import numpy as np
import pyarrow.parquet as pq


def measured(folder, least=0.2, nearest=30, thresholds=(0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4)):
    """(threshold, recall, precision) of the hidden labels, at the threshold that serves them best."""
    documents = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    documents = [(r["doc_id"], set(re.findall(r"[^\W\d_]{3,}", r["text"].lower()))) for r in documents if r["text"]]
    labels = pq.read_table(f"{folder}/doc_labels.parquet").to_pylist()
    subjects = sorted({r["subject"] for r in labels})
    held = Counter(t for _, terms in documents for t in terms)
    places = {t: k for k, t in enumerate(t for t, n in held.items() if n >= 3)}
    vectors = np.zeros((len(documents), len(places)), np.float32)
    for row, (_, terms) in enumerate(documents):
        for t in terms & places.keys():
            vectors[row, places[t]] = np.log(len(documents) / held[t])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    of = {doc: row for row, (doc, _) in enumerate(documents)}
    clamped, hidden = np.zeros((len(documents), len(subjects))), {}
    for r in labels:
        if r["doc_id"] in of:
            row, k = of[r["doc_id"]], subjects.index(r["subject"])
            if r["doc_id"] % 5:
                clamped[row, k] = 1
            else:
                hidden.setdefault(row, set()).add(k)
    known = clamped.any(axis=1)
    clamped[known] /= clamped[known].sum(axis=1, keepdims=True)
    ends = []
    for at in range(0, len(documents), 1000):
        cosines = vectors[at : at + 1000] @ vectors.T
        cosines[np.arange(len(cosines)), np.arange(at, at + len(cosines))] = 0
        top = np.argpartition(-cosines, nearest, axis=1)[:, :nearest]
        row, k = np.nonzero(np.take_along_axis(cosines, top, 1) >= least)
        ends.append((row + at, top[row, k], cosines[row, top[row, k]]))
    a, b, weight = map(np.concatenate, zip(*ends))
    shares = clamped
    for _ in range(100):
        new = np.stack([np.bincount(a, weight * shares[b, k], len(documents)) for k in range(len(subjects))], axis=1)
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-12)
        new[known] = clamped[known]
        moved, shares = np.abs(new - shares).sum() / len(documents), new
        if moved < 1e-3:
            break
    best = (0, None)
    for least_share in thresholds:
        found = {row: set(np.flatnonzero(shares[row] >= least_share)) for row in hidden}
        both = sum(len(found[row] & own) for row, own in hidden.items())
        recall, precision = both / sum(map(len, hidden.values())), both / max(1, sum(map(len, found.values())))
        best = max(best, (2 * recall * precision / max(recall + precision, 1e-12), (least_share, recall, precision)))
    return best[1]


if __name__ == "__main__":
    for nearest in (10, 30, 100):
        print(nearest, "nearest: threshold, recall, precision", *(round(x, 3) for x in measured(sys.argv[1], nearest=nearest)))

"""License scans: MinHash bands over overlapping text windows.

Templates are put in classes by length. A text is cut into windows of twice the
class's length, each beginning half a window after the last, so an occurrence of
a template lies whole in some window. Of each window the MinHash values of its
five-word shingles are taken in bands; a window and a template that agree in a
band are a candidate. A window that holds a template whole has Jaccard at least
``s = shingles(T) / shingles(window)``, and the number of bands is set so that
such a pair collides in some band with probability ``1 - (1 - s**rows)**bands``
of at least ``collision``. Each candidate is verified by exact containment: the
share of the template's shingles within the window.

A band can only agree where the window holds the template's own minimal shingle,
so windows without any template shingle are not hashed: the bands would find
nothing there (``scan_text`` without the table of shingles hashes every window, and
a test holds both against each other).

Cases: null or short texts (below five words) have no shingles and match nothing; a
text of any length is scanned whole, window by window; a null doc_id is reported
with a null;
templates below five words are refused; a template found in several places gives
one row with the number of windows and the best containment; repeated rows are
each reported; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import chunks, lean, shingle_hashes, texts

WORDS = 5
CONTAINMENT = 0.8
ROWS = 1
COLLISION = 0.999
#: Classes: templates of up to so many words share a window length.
CLASSES = (8, 16, 64, 256, 1024)
_OUTER = bytes(c for c in range(128) if not chr(c).isalnum())

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. ")
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")

#: Common licence notices, and whole short licences.
TEMPLATES = {
    "mit": _GRANT + "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause": _CLAUSES + _AS_IS,
    "bsd-3-clause": _CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. " + _AS_IS,
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
    "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
    "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
    "or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation.",
}


class Words(dict):
    """Hash of a lower-case word without outer punctuation; 0 if nothing is left."""

    LIMIT = 400_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        x = w.strip(_OUTER)
        v = self[w] = xxhash.xxh64_intdigest(x) | 1 if x else 0
        return v

    def of(self, text: bytes) -> np.ndarray:
        w = text.lower().split()
        h = np.fromiter(map(self.__getitem__, w), np.uint64, len(w))
        return h[h != 0]


def minhash(grams: np.ndarray, n: int) -> np.ndarray:
    """n minima of keyed multiply-shift hashes of the shingles."""
    rng = np.random.default_rng(17)
    a, b = rng.integers(1, 2**63, (2, n), dtype=np.uint64)
    x = (grams[:, None] ^ b[None, :]) * (a[None, :] | np.uint64(1))
    x ^= x >> np.uint64(32)
    return x.min(axis=0)


def bands_needed(template: int, window: int, rows: int = ROWS, collision: float = COLLISION, containment: float = CONTAINMENT) -> int:
    """Bands for the collision probability at the least similarity a verified pair can have."""
    hit = math.ceil(containment * template)
    s = hit / (template + window - hit)
    return max(1, math.ceil(math.log(1 - collision) / math.log(1 - s**rows))) if s < 1 else 1


def compile_templates(templates: dict[str, str], rows: int = ROWS) -> list[dict]:
    """Templates per length class, with window length, bands and band keys."""
    words, out = Words(), {}
    for name, text in sorted(templates.items()):
        w = words.of(text.encode())
        if len(w) < WORDS:
            raise ValueError(f"template {name} has fewer than {WORDS} words")
        limit = next(c for c in (*CLASSES, len(w)) if len(w) <= c)
        out.setdefault(limit, []).append((name, np.unique(shingle_hashes(w, WORDS))))
    made = []
    for limit, group in sorted(out.items()):
        window = 2 * limit
        bands = max(bands_needed(len(g), window - WORDS + 1, rows) for _, g in group)
        sig = [minhash(g, bands * rows).reshape(bands, rows) for _, g in group]
        made.append({"limit": limit, "window": window, "bands": bands, "names": [n for n, _ in group], "grams": [g for _, g in group], "sig": np.stack(sig)})
    return made


def scan_text(words: np.ndarray, classes: list[dict], every: np.ndarray | None, rows: int, containment: float) -> dict[str, list]:
    """name -> [best containment, windows, first word] for one text; ``every`` holds
    the templates' shingles in order, None hashes all windows."""
    grams = shingle_hashes(words, WORDS) if len(words) >= WORDS else np.zeros(0, np.uint64)
    known = np.arange(len(grams)) if every is None else np.flatnonzero(every[np.searchsorted(every, grams).clip(0, len(every) - 1)] == grams) if len(grams) else []
    found: dict[str, list] = {}
    if not len(known):
        return found
    for c in classes:
        step, span = c["limit"], c["window"] - WORDS + 1
        last = max(0, -(-(len(words) - c["window"]) // step))
        starts = np.unique(np.concatenate([(known // step) - 1, known // step]).clip(0, last)) * step
        for s in starts.tolist():
            g = np.unique(grams[s : s + span])
            if not len(g):
                continue
            sig = minhash(g, c["bands"] * rows).reshape(c["bands"], rows)
            for t in np.flatnonzero((c["sig"] == sig[None]).all(axis=2).any(axis=1)).tolist():
                share = len(np.intersect1d(c["grams"][t], g, assume_unique=True)) / len(c["grams"][t])
                if share >= containment:
                    x = found.setdefault(c["names"][t], [0.0, 0, s])
                    x[0], x[1], x[2] = max(x[0], share), x[1] + 1, min(x[2], s)
    return found


def license_matches(documents: DataFrame, templates: dict[str, str] = TEMPLATES, rows: int = ROWS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, windows, first_word for every match."""
    shared = documents.sparkSession.sparkContext.broadcast(compile_templates(templates, rows))

    def run(batches):
        classes, words = shared.value, Words()
        every = np.unique(np.concatenate([g for c in classes for g in c["grams"]]))
        for b in chunks(batches, "text"):
            out = [
                (i, name, *x) for i, t in enumerate(texts(b, "text"))
                for name, x in sorted(scan_text(words.of(t), classes, every, rows, containment).items())
            ]
            if out:
                i, name, share, n, first = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(i)), pa.array(name), pa.array(share), pa.array(n, pa.int64()), pa.array(first, pa.int64())],
                    ["doc_id", "license", "containment", "windows", "first_word"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lean(run), "doc_id long, license string, containment double, windows long, first_word long")

"""License scan by MinHash bands over overlapping windows, with DataFrame expressions only.

A text's 3-word shingles are read in windows of WINDOW shingles that overlap by half; templates are
cut into segments of at most SEGMENT shingles. A window that holds a whole segment of three or more
shingles has a Jaccard similarity J of at least 3 / WINDOW with it; BANDS one-row bands then share
a value with probability 1 - (1 - J) ** BANDS. What shares a band is verified by exact containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, small, text_or_empty, words

SHINGLE, WINDOW, SEGMENT, BANDS, SHARE = 3, 8, 5, 20, 0.8
#: Notices and short full texts of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
        "AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
        "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def miss_probability(shingles: int = 3, window: int = WINDOW, bands: int = BANDS) -> float:
    """Chance that a window with a whole segment of so many shingles shares no band with it."""
    return (1 - shingles / window) ** bands


def _seeds() -> list[int]:
    """Fixed, well spread masks: multiples of an odd constant, as signed 64-bit integers."""
    out = []
    for i in range(1, BANDS + 1):
        x = (i * 0x9E3779B97F4A7C15) & (2**64 - 1)
        x ^= x >> 29
        x = (x * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        out.append(x - 2**64 if x >= 2**63 else x)
    return out


def plain_words(text: Column) -> Column:
    """Lower-case words without punctuation; words of punctuation alone are left out."""
    return words(F.lower(F.regexp_replace(text, "[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+", "")))


def _banded(df: DataFrame, keep: list[str], shingles: int) -> DataFrame:
    """(keep, band): for each mask the least value of the hashes h0, h1, ... under it, told apart by mask."""
    each = df.select(*keep, *[f"h{k}" for k in range(shingles)], F.explode(F.array(*map(F.lit, _seeds()))).alias("seed"))
    return each.select(*keep, F.xxhash64("seed", F.least(*[F.col(f"h{k}").bitwiseXOR(F.col("seed")) for k in range(shingles)])).alias("band"))


def _windows(df: DataFrame, keep: list[str], shingles: int, stride: int) -> DataFrame:
    """(keep, window, h0, h1, ...): the hashes of `shingles` shingles from every `stride`-th word of the column `w`.

    Window numbers are exploded and words read by position, so that hashes are computed in compiled
    code. The last window may be shorter (nulls); a text of fewer than SHINGLE words has none.
    """
    last = F.greatest(F.lit(0), F.floor((F.size("w") - SHINGLE - 1) / stride)).cast("int")
    each = df.select(*keep, "w", F.explode_outer(F.sequence(F.lit(0), last)).alias("window"))
    at = lambda k: F.get("w", F.col("window") * stride + k)
    hash_ = lambda k: F.xxhash64(*[at(k + j) for j in range(SHINGLE)])
    first = each.filter(at(SHINGLE - 1).isNotNull())
    return first.select(*keep, "window", *[F.when(at(k + SHINGLE - 1).isNotNull(), hash_(k)).otherwise(hash_(0)).alias(f"h{k}") for k in range(shingles)])


def _shingle_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, k, shingle): the hash of every shingle of the column `w`, k counted from 0."""
    at = F.greatest(F.lit(0), F.size("w") - SHINGLE)
    each = df.select(*keep, "w", F.explode_outer(F.sequence(F.lit(0), at)).alias("k")).filter(F.get("w", F.col("k") + SHINGLE - 1).isNotNull())
    return each.select(*keep, "k", F.xxhash64(*[F.get("w", F.col("k") + j) for j in range(SHINGLE)]).alias("shingle"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license_id, w, size); templates of fewer than SHINGLE words can't be matched and are left out."""
    rows = spark.createDataFrame([*templates.items()], "license_id string, text string").withColumn("w", plain_words(text_or_empty("text")))
    return rows.select("license_id", "w", F.size("w").alias("size")).filter(F.col("size") >= SHINGLE)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text_hash, license_id, containment): the best containment of each template found in a document.

    A template is verified among the words around each window that retrieved it. A text's shingles are
    hashed once, those of templates are kept by tiles as long as such a region, and a region reads its own tile, which also
    holds the next one; so the work grows with a text's length. Only containments of at least SHARE are returned. Null, empty and very short texts match nothing;
    rows that repeat a document give one row. Other columns are ignored.
    """
    docs = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("text_hash", F.md5("text"))
    own = checkpointed(template_table(docs.sparkSession, templates or TEMPLATES))
    bands = checkpointed(_banded(_windows(own, ["license_id"], SEGMENT, SEGMENT - 2), ["license_id"], SEGMENT).distinct())
    rows = docs.select("doc_id", "text_hash", plain_words(F.col("text")).alias("w"))
    signed = _banded(_windows(rows, ["doc_id", "text_hash"], WINDOW, WINDOW // 2), ["doc_id", "text_hash", "window"], WINDOW)
    met = checkpointed(signed.join(small(bands), "band").select("doc_id", "text_hash", "license_id", "window").distinct())

    half, sizes = WINDOW // 2, small(own.select("license_id", "size"))
    tile = lambda word: F.floor(word / (2 * F.col("size") + WINDOW + SHINGLE)).cast("int")
    start = F.greatest(F.lit(0), F.col("window") * half - F.col("size"))
    tried = met.select("text_hash", "license_id", "window").distinct().join(sizes, "license_id")
    tried = tried.select("text_hash", "license_id", start.alias("start"), (F.col("window") * half + F.col("size") + WINDOW).alias("last"), tile(start).alias("tile"))
    found = docs.join(small(checkpointed(met.select("text_hash").distinct())), "text_hash", "left_semi").select("text_hash", "text").dropDuplicates(["text_hash"])
    known = checkpointed(_shingle_rows(own, ["license_id", "size"]).select("license_id", "size", "shingle").distinct())
    held = _shingle_rows(found.select("text_hash", plain_words(F.col("text")).alias("w")), ["text_hash"]).join(small(known), "shingle")
    held = held.withColumn("tile", F.explode(F.array(tile(F.col("k")) - 1, tile(F.col("k")))))
    held = held.groupBy("text_hash", "license_id", "tile").agg(F.collect_list(F.struct("k", "shingle")).alias("near"))
    many = known.groupBy("license_id").agg(F.count("*").alias("many"))
    both = tried.join(held, ["text_hash", "license_id", "tile"]).join(small(many), "license_id").select("text_hash", "license_id", "start", "last", "near", "many")
    inside = F.filter("near", lambda x: (x["k"] >= F.col("start")) & (x["k"] <= F.col("last")))
    share = F.size(F.array_distinct(F.transform(inside, lambda x: x["shingle"]))) / F.col("many")
    best = checkpointed(both.groupBy("text_hash", "license_id").agg(F.max(share).alias("containment")).filter(F.col("containment") >= SHARE))
    return met.select("doc_id", "text_hash", "license_id").distinct().join(small(best), ["text_hash", "license_id"]).select("doc_id", "text_hash", "license_id", "containment")

"""URL filters: a memory-mapped, sorted array of 64-bit xxhash keys.

Every rule and every blocked prefix is one string `host + path prefix`. Their
digests are stored sorted in one file, next to the strings. Each task maps the
file into memory (the workers of a machine share its pages), probes all
candidate strings of a batch with one vectorised binary search, and confirms
each hit against the stored string, so that a digest collision can't decide.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator, Sequence
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import ASCII_LOWER

ALLOW, BLOCK, LISTED = 0, 1, 2
VERDICTS = ("allow", "block")
#: Bytes of a block list that is mapped at most, and what a key takes besides its string.
MAPPED_BYTES, KEY_BYTES = 64 * 2**20, 33
_sent: set[tuple[str, str]] = set()
RESULT = "host string, path string, rule string, listed string, verdict string"


class DigestArray:
    """Sorted digests with their strings, in one file that is mapped: keys, and
    the hosts of the keys with the lengths of the paths that each has, so that a
    URL is probed with the prefixes that its own hosts ask for. Opening reads
    the head only; its time doesn't depend on the number of keys."""

    def __init__(self, path: str):
        n, blob, hosts, paths, self.labels = (int(x) for x in np.fromfile(path, np.uint64, 5))
        at = 40

        def view(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.memmap(path, kind, "r", at, (count,)) if count else np.zeros(0, kind)
            at += count * np.dtype(kind).itemsize
            return out

        self.digests, self.offsets = view(np.uint64, n), view(np.uint64, n + 1)
        self.hosts, self.path_ends = view(np.uint64, hosts), view(np.uint64, hosts + 1)
        self.paths, self.codes, self.blob = view(np.uint32, paths), view(np.uint8, n), view(np.uint8, blob)

    def key(self, i: int) -> str:
        return self.blob[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes().decode()

    @staticmethod
    def build(entries: dict[str, int], path: str, digest=xxhash.xxh64_intdigest) -> None:
        order = sorted((digest(k.encode()), k) for k in entries)
        raw = [k.encode() for _, k in order]
        lengths: dict[int, set[int]] = defaultdict(set)
        labels = 0
        for k in entries:
            host = k.split("/", 1)[0]
            labels = max(labels, host.count(".") + 1)
            lengths[digest(host.encode())].add(len(k) - len(host))  # hosts of one digest share their lengths: a prefix too many finds no key
        hosts = sorted(lengths)
        per_host = [sorted(lengths[h]) for h in hosts]
        with open(path, "wb") as f:
            f.write(np.array([len(order), sum(map(len, raw)), len(hosts), sum(map(len, per_host)), labels], np.uint64).tobytes())
            f.write(np.array([d for d, _ in order], np.uint64).tobytes())
            f.write(np.cumsum([0, *map(len, raw)]).astype(np.uint64).tobytes())
            f.write(np.array(hosts, np.uint64).tobytes())
            f.write(np.cumsum([0, *map(len, per_host)]).astype(np.uint64).tobytes())
            f.write(np.array([n for x in per_host for n in x], np.uint32).tobytes())
            f.write(np.array([entries[k] for _, k in order], np.uint8).tobytes())
            f.write(b"".join(raw))

    def probe(self, strings: Sequence[str], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """For each string the place of its entry, or -1."""
        asked = np.fromiter((digest(s.encode()) for s in strings), np.uint64, len(strings))
        at = np.searchsorted(self.digests, asked)
        found = np.full(len(strings), -1, np.int64)
        open_ = np.flatnonzero(at < len(self.digests))
        while len(open_):
            open_ = open_[self.digests[at[open_]] == asked[open_]]
            same = np.fromiter((self.key(at[i]) == strings[i] for i in open_), bool, len(open_))
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1  # the next entry may have the same digest
            open_ = open_[at[open_] < len(self.digests)]
        return found

    def candidates(self, split: Sequence[tuple[str, str]], digest=xxhash.xxh64_intdigest) -> tuple[list[str], list[int]]:
        """Every string of an entry that could fit, and the (host, path) it is
        from: the host and its parent domains, of as many labels as any entry
        has, with the path prefixes of the lengths that this host's entries have."""
        ends, owner = [], []
        for i, (host, _) in enumerate(split):
            parts = host.split(".")
            for k in range(max(0, len(parts) - self.labels), len(parts)):
                if end := ".".join(parts[k:]):
                    ends.append(end), owner.append(i)
        asked = np.fromiter((digest(e.encode()) for e in ends), np.uint64, len(ends))
        at = np.searchsorted(self.hosts, asked)
        known = np.flatnonzero(at < len(self.hosts))
        known = known[self.hosts[at[known]] == asked[known]]
        out, whose = [], []
        for j in known:
            path = split[owner[j]][1]
            for n in self.paths[int(self.path_ends[at[j]]) : int(self.path_ends[at[j] + 1])]:
                if n <= len(path):
                    out.append(ends[j] + path[:n]), whose.append(owner[j])
        return out, whose


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty without `://`."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(ASCII_LOWER), path


def _entries(rules, listed) -> dict[str, int]:
    found = {_key(k): LISTED for k in listed}
    return found | {_key(k): VERDICTS.index(action) for action, k in rules}


def _key(key: str) -> str:
    """An entry with A-Z lower-cased in its host; paths stay as they are."""
    host, slash, rest = key.partition("/")
    return host.translate(ASCII_LOWER) + slash + rest


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    listed: Sequence[str] | DataFrame = (),
    id_col: str = "page_id",
    url_col: str = "url",
    max_bytes: int = MAPPED_BYTES,
) -> DataFrame:
    """Judges every URL: the longest fitting rule decides; without one, an
    entry of the block list (`listed`) that fits blocks; the rest is allowed.

    pages: any DataFrame; only id_col and url_col are read, so other columns
    may have any name. rules: (allow or block, `host/path prefix`). listed: the
    block list as strings, or a DataFrame whose first column has them; the size
    of its distinct keys is summed first, and above max_bytes they are joined
    instead of mapped (see _by_join), with the same result. Nulls: a null URL
    has empty host and path and is allowed; a null id stays null. Repeated rows
    are judged one by one; an empty table gives an empty result. Ties between
    rules of one length go to the longer host.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    if isinstance(listed, DataFrame):
        raw = F.col(f"`{listed.columns[0]}`")
        host = F.substring_index(raw, "/", 1)
        lower = F.translate(host, ascii_uppercase, ascii_lowercase)
        keys = listed.select(F.concat(lower, F.substring(raw, F.length(host) + 1, F.length(raw))).alias("k")).where("k is not null").distinct()
        size = keys.agg(F.coalesce(F.sum(F.octet_length("k") + KEY_BYTES), F.lit(0)).alias("n")).first().n
        if size > max_bytes:
            own = [_key(k) for _, k in rules]  # a rule takes the place of an equal key
            return _by_join(filter_urls(pages, rules, (), id_col, url_col), keys.where(~F.col("k").isin(own)) if own else keys, id_col)
        listed = keys.toArrow().column("k").to_pylist()
    entries = _entries(rules, listed)
    name = _published(spark, entries)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            ids, urls = batch.columns
            split = [split_url(u) for u in urls.to_pylist()]
            asked, owner = array.candidates(split)
            best: list = [None] * len(split)
            hit: list = [None] * len(split)
            found = array.probe(asked)
            for j in np.flatnonzero(found >= 0):
                i, key, code = owner[j], asked[j], int(array.codes[found[j]])
                if code == LISTED:
                    hit[i] = max(hit[i] or "", key, key=len)
                else:
                    best[i] = max(best[i] or (0, 0, "", 0), (len(key), len(key.split("/", 1)[0]), key, code))
            rule = [b and b[2] for b in best]
            verdict = [VERDICTS[b[3]] if b else VERDICTS[h is not None] for b, h in zip(best, hit)]
            texts = [[h for h, _ in split], [p for _, p in split], rule, hit, verdict]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(x, pa.string()) for x in texts)], [id_col, *(c.split()[0] for c in RESULT.split(", "))]
            )

    return pages.select(id_col, url_col).mapInArrow(judge, f"`{id_col}` {kind}, {RESULT}")


def _published(spark: SparkSession, entries: dict[str, int]) -> str:
    """Hands the file to every executor; named by its content."""
    folder = tempfile.mkdtemp(prefix="urls-")  # the driver serves it from here
    path = os.path.join(folder, "array")
    DigestArray.build(entries, path)
    with open(path, "rb") as f:
        name = f"urls-{hashlib.file_digest(f, 'sha256').hexdigest()[:24]}"
    if (sent := (spark.sparkContext.applicationId, name)) not in _sent:
        os.rename(path, os.path.join(folder, name))
        spark.sparkContext.addFile(os.path.join(folder, name))
        _sent.add(sent)
    return name


def _by_join(judged: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    """For block lists beyond the bound: the parent domains of a URL are joined
    with the hosts of the keys, which have the path lengths of their keys, and
    the prefixes of these lengths with the keys."""
    host = F.substring_index("k", "/", 1)
    hosts = keys.groupBy(host.alias("end")).agg(F.collect_set((F.length("k") - F.length(host)).cast("int")).alias("lengths"))
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = judged.withColumn("row_", F.monotonically_increasing_id())
    asked = rows.where("host <> ''").select("row_", "path", F.explode(F.filter(ends, lambda h: h != "")).alias("end")).join(hosts, "end")
    heads = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.concat("end", F.substring(F.col("path"), F.lit(1), n)))
    hits = (
        asked.select("row_", F.length("end").alias("n"), F.explode(heads).alias("k"))
        .join(keys, "k").groupBy("row_").agg(F.max_by("k", F.struct(F.length("k"), "n")).alias("hit_"))
    )
    return rows.join(hits, "row_", "left").select(
        id_col, "host", "path", "rule", F.coalesce("hit_", "listed").alias("listed"),
        F.when(F.col("rule").isNull() & F.col("hit_").isNotNull(), "block").otherwise(F.col("verdict")).alias("verdict"),
    )

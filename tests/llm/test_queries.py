"""The registered queries: columns, types and values on the given tables."""

import html
import re
from base64 import b32encode
from collections import Counter
from hashlib import sha1
from itertools import combinations
from zlib import crc32

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

KINDS = {
    "op1_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_archives": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.fixture(scope="module")
def results(spark):
    kept = {}

    def result(name, sf_dir):
        if (name, sf_dir) not in kept:
            df = entry.queries()[name](spark, sf_dir)
            assert dict(df.dtypes) == KINDS[name]
            kept[name, sf_dir] = df.collect()
        return kept[name, sf_dir]

    return result


def rows_of(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()


def test_main_text(spark, results):
    found = {r.page_id: r for r in results("op1_main_text", MIDDLE)}
    pages, right = rows_of(spark, MIDDLE, "pages"), 0
    assert len(found) == len(pages)
    for p in pages:
        article = p.html.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0].replace("<br>", " ")
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", article))
        right += found[p.page_id].text == "\n\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)
        assert found[p.page_id].url == p.url and found[p.page_id].n_chars == len(found[p.page_id].text)
    assert right >= 0.98 * len(pages)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, results):
    found = {r.doc_id: r for r in results("op2_simhash", SMALL)}
    prints = {d.doc_id: fingerprint(d.text) for d in rows_of(spark, SMALL, "documents")}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4 and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert {i: r.component_id for i, r in found.items()} == {i: top(i) for i in prints}


def test_token_counts(spark, results):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in results("op3_token_counts", SMALL)}
    for d in rows_of(spark, SMALL, "documents"):
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert tuple(found[d.doc_id])[1:] == (len((d.text or "").encode()), n, n > 1024)


def test_source_mix(spark, results):
    found = results("op4_source_mix", MIDDLE)
    docs = {d.doc_id: d for d in rows_of(spark, MIDDLE, "documents")}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    sources = sorted({d.source for d in docs.values()}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, d in docs.items() if d.source == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, left, open_to = dict.fromkeys(sources, 0.0), float(sum(total.values())), set(sources)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_to) for s in open_to}
        above = {s for s in open_to if share[s] > 3 * total[s]}
        target.update(share)
        if not above:
            break
        for s in above:
            target[s], left = 3.0 * total[s], left - 3 * total[s]
        open_to -= above
    taken = Counter()
    for r in found:
        source = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], total[source]) and abs(r.target - target[source]) < 1e-6 * max(target[source], 1)
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert len(found) == len(docs)
    for s in sources:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 1


def test_language(spark, results):
    docs = {d.doc_id: d for d in rows_of(spark, MIDDLE, "documents")}
    found = results("op5_language", MIDDLE)
    assert len(found) == len(docs) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r.lang_pred == docs[r.doc_id].lang for r in found if r.held_out and docs[r.doc_id].lang is not None]
    assert sum(held) / len(held) >= 0.95


def test_language_learns_nothing_from_held_out_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = f"{tmp_path}/documents.parquet"
    docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end as lang", "'s' as source", "n_chars").write.parquet(path)
    one, two = (sorted(entry.queries()["op5_language"](spark, d).collect()) for d in (SMALL, str(tmp_path)))
    assert one == two


def test_archives(spark, results):
    pages = {p.page_id: (p.html or "").encode() for p in rows_of(spark, MIDDLE, "pages")}
    least = {}
    for i, payload in sorted(pages.items(), reverse=True):
        least[payload] = i
    found = results("op6_archives", MIDDLE)
    assert len(found) == len(pages)
    for r in found:
        payload = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), b32encode(sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if least[payload] == r.page_id else ("revisit", least[payload]))


def test_toxicity(spark, results):
    toxic = {r.doc_id: r.toxic for r in rows_of(spark, "/root/testdata/sf0.1", "labels")}
    found = results("op10_toxicity", "/root/testdata/sf0.1")
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    held = [(r.predicted, toxic[r.doc_id]) for r in found if r.held_out and toxic.get(r.doc_id) is not None]
    caught, alarms = ([p for p, t in held if t == k] for k in (1, 0))
    assert sum(caught) / len(caught) >= 0.85 and sum(alarms) / len(alarms) <= 0.02

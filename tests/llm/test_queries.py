"""The registered queries on the smallest tables: result columns, and brute-force versions of what SQL cannot express."""
import hashlib
import zlib
from collections import defaultdict

import pytest

from conftest import SF_SMALL
from tessera.llm import chat, decontam
from tessera.llm.encoding import load, u32
from tessera.llm.queries import QUERIES, tokenizer_path

COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_near_dedup": "doc_id bigint, class_id bigint",
    "op3_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4_decontamination": "doc_id bigint, item_id bigint, n_tiles int, longest_tile int, matched_words int, item_words int, coverage double",
    "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op7_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name in COLUMNS:
        df = QUERIES[name](spark, SF_SMALL)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        out[name] = df.collect()
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


def test_one_row_per_document(results, docs):
    for name in ("op1_toxicity", "op2_near_dedup", "op3_licenses", "op5_token_counts", "op8_quality", "op9_token_ids",
                 "op11_periodic_runs", "op12_token_alignment", "op13_exact_dedup"):
        assert sorted(r.doc_id for r in results[name]) == sorted(docs), name


def test_toxicity_fold(results):
    for r in results["op1_toxicity"]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1


def test_near_duplicates_by_all_pairs(results, docs):
    windows = {}
    for i, t in docs.items():
        w = decontam.words_of(t)
        windows[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
    label = {r.doc_id: r.class_id for r in results["op2_near_dedup"]}
    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = windows[a], windows[b]
            both = len(x & y)
            if docs[a] == docs[b] or both and both >= 0.8 * (len(x) + len(y) - both):
                assert label[a] == label[b], (a, b)
            elif label[a] == label[b]:
                assert both, (a, b)   # in a class only through others


def test_benchmark_items(results, docs, spark):
    items = {r.item_id: decontam.words_of(r.text or "") for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in results["op4_decontamination"]}
    for i, t in docs.items():
        line = " " + " ".join(decontam.words_of(t)) + " "
        for k, words in items.items():
            if words and f" {' '.join(words)} " in line:
                assert (i, k) in found


def test_token_counts_by_the_library(results, docs):
    library = load(tokenizer_path("byte_bpe_50k.json"))
    for r in results["op5_token_counts"]:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_packing_by_the_library(results, docs):
    library = load(tokenizer_path("byte_bpe_50k.json"))
    rows, by = defaultdict(list), defaultdict(list)
    for r in results["op7_packing"]:
        rows[r.doc_id].append(r)
        by[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in docs.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(rows[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(u32(ids[at:at + r.length])))
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids)
    for parts in by.values():
        ends = [0]
        for offset, n in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 2048
    assert len(by) <= 1.05 * -(-total // 2048) + 1


def test_id_files_by_the_library(results, docs):
    library = load(tokenizer_path("word_bpe_49k.json"))
    at = 0
    for r in sorted(results["op9_token_ids"], key=lambda r: r.doc_id):
        ids = [*library.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(u32(ids)))
        at += len(ids)


def test_chat_digests(results, spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r.conv_id for r in results["op6_chat"]} == set(turns)
    for r in results["op6_chat"]:
        own = sorted(turns[r.conv_id])
        loss = "".join(x for _, role, x in own if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, role, x in own)
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render_turn(role, x)) for _, role, x in own)

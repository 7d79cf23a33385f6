"""Corpus operators against brute force on small tables, and on awkward rows."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gapscope.llm import (binary, chat, decontamination, extraction, language, load, neardup, packing, rans, rules,
                          secrets, tokens, toxicity)
from gapscope.llm.common import prepare, table

SF = "/root/testdata/sf0.001"
LONG = "lang long " * 30_000
AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "two words"), (6, LONG), (7, "same text here again"), (8, "same text here again"),
           (8, "same text here again"), (None, "no id"), (9, "naïve Straße — 東京 🙂 é <|endoftext|> \x1c x")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty, blank, short, very long, repeated rows, a null id, and extra columns with clashing names."""
    prepare(spark)
    rows = [(i, t, "x", None, 0.5, 1) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, lang string, kept double, n int")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.filter("false")


@pytest.fixture(scope="module")
def documents(spark):
    prepare(spark)
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.fixture(scope="module")
def encoded(texts):
    full = tokens.worker_tokenizer().full
    return {i: full.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_registered():
    found, _ = load()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 11))


# tokens, files, packing


def test_chunk_tokenizer_equals_library():
    t = tokens.worker_tokenizer()
    for text in [x or "" for _, x in AWKWARD] + ["It's ΑΣ Σ don't!! a\x1cb \x85 İ é １２ 12ab's \xa0x ﬁ ǅ ß ª ² Ⅷ <|startoftext|>y", "a" * 5000]:
        assert np.frombuffer(t.encode([text])[0], "<u2").tolist() == t.full.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, documents, encoded, tmp_path):
    binary.write_ids(documents, str(tmp_path / "files"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in binary.read_ids(spark, str(tmp_path / "files")).collect()}
    start, want = 0, {}
    for i in sorted(encoded):
        want[i] = (start, len(encoded[i]), crc(encoded[i]))
        start += len(encoded[i])
    assert got == want


def test_token_files_awkward(spark, awkward, empty, tmp_path):
    binary.write_ids(awkward, str(tmp_path / "a"))
    rows = sorted(binary.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    assert [r.n_tokens for r in rows][1:4] == [1, 1, 1] and rows[-1].start + rows[-1].n_tokens == sum(r.n_tokens for r in rows)
    binary.write_ids(empty, str(tmp_path / "e"))
    assert binary.read_ids(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 1025, 300_000])
def test_coder_blocks_checkpoints_and_damage(n):
    ids = np.random.default_rng(n).zipf(1.4, n).clip(0, 49_000).astype(np.uint16)
    shared = rans.Table(rans.frequencies(np.bincount(ids, minlength=49_408)))
    data = rans.pack_file(shared, [rans.encode_block(ids, [n], [77], shared)])
    opened, blocks = rans.open_file(data)
    keys, lengths, back = rans.decode_block(blocks[0], opened)
    assert keys.tolist() == [77] and lengths.tolist() == [n] and (back == ids).all()
    if n > 1024 * rans.CHECKPOINT_STEPS:  # decoding may start at a checkpoint
        lanes, at = 1024, rans.CHECKPOINT_STEPS
        assert (rans.decode_block(blocks[0], opened, at, at + 3)[2] == ids[at * lanes:(at + 3) * lanes]).all()
    broken = bytearray(data)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.open_file(bytes(broken))


def check_packing(rows, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert crc(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW
    return [sum(r.length for r in found) for found in sequences.values()]


def test_packing_places_every_id_once(documents, encoded):
    sizes = check_packing(packing.pack(documents).collect(), encoded)
    assert all(n == packing.WINDOW or n & (n - 1) == 0 for n in sizes)


def test_packing_awkward(awkward, empty):
    rows = packing.pack(awkward).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 2, 3)) == 3 and Counter(r.doc_id for r in rows)[8] >= 2
    assert packing.pack(empty).count() == 0


def packed(lengths):
    """Pieces of documents of the given token numbers, with what waited at most between two documents."""
    ids = {i: np.arange(n, dtype="<u2") for i, n in enumerate(lengths)}
    packer, most = packing.Packer(0), 0
    for i, x in ids.items():
        packer.add(i, x)
        most = max(most, packer.n_waiting)
        assert packer.n_waiting == sum(map(len, packer.waiting.values()))
    packer.finish()
    rows = [Row(**r) for r in packer.drain().to_pylist()]
    return check_packing(rows, {i: x.tolist() for i, x in ids.items()}), most


@pytest.mark.parametrize("lengths", [[1500] * 30_000, [4095] * 9000 + [2, 3], [n % 3 + 1365 for n in range(20_000)], [4096] * 3 + [1], [7]])
def test_packing_of_equal_lengths_is_bounded(lengths):
    sizes, most = packed(lengths)
    assert sum(sizes) == sum(lengths) and most < packing.GROUP_RESTS
    short = [n for n in sizes if n != packing.WINDOW]
    assert len(set(short)) == len(short) and all(n & (n - 1) == 0 for n in short)


def test_packing_of_mixed_lengths_cuts_few():
    lengths = np.random.default_rng(2).lognormal(6, 1, 12_000).astype(int).clip(1, 20_000).tolist()
    sizes, most = packed(lengths)
    assert sum(sizes) == sum(lengths) and most < packing.GROUP_RESTS and sum(n != packing.WINDOW for n in sizes) <= 12


def test_closest_fill_against_all_subsets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        items = rng.integers(1, 30, rng.integers(0, 9)).tolist()
        capacity = int(rng.integers(0, 90))
        reach = {0}
        for n in items:
            reach |= {a + n for a in reach}
        counts = Counter(items)
        best, chosen = packing.closest_fill(counts, capacity)
        assert best == max(a for a in reach if a <= capacity) == sum(n * c for n, c in chosen.items())
        assert all(counts[n] >= c for n, c in chosen.items())


# secrets


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_secrets_structures():
    import base64
    import json
    number = der(2, b"\x01" * 64)
    key = der(0x30, der(2, b"\0") + number * 8)
    wrapped = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, key))
    curve = der(0x30, der(2, b"\1") + der(4, b"\7" * 32) + der(0xA0, der(6, b"\x2a\x86")))
    for data in (key, wrapped, curve):
        assert secrets.is_private_key(data)
        assert not secrets.is_private_key(data[:-1]) and not secrets.is_private_key(data + b"\0") and not secrets.is_private_key(b"\x31" + data[1:])
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub": 1}', b"sig"))
    patterns = secrets.compiled()
    text = f"é {base64.b64encode(key).decode()} {token} {key.hex()} -----BEGIN PRIVATE KEY-----\n{base64.b64encode(wrapped).decode()}\n-----END PRIVATE KEY-----"
    kinds = Counter(secrets.KINDS[k] for _, k, _ in secrets.structural_spans(text, patterns))
    assert kinds["signed_token"] == 1 and kinds["hex_key"] == 1 and kinds["pem_key"] == 1 and kinds["der_key"] >= 1
    plain = base64.b64encode(b"just a long sentence without any structure at all, really").decode()
    assert not secrets.structural_spans(f"{plain} {'ab' * 40} eyJhbGciOiJ.e30.x", patterns)
    assert "HS256" not in secrets.redact(text, secrets.structural_spans(text, patterns)) and secrets.redact("a", []) == "a"


def test_secrets_wrapped_url_safe_and_armoured():
    import base64
    import random
    noise = random.Random(3).randbytes
    number = der(2, b"\x01" * 64)
    key = der(0x30, der(2, b"\0") + der(2, b"\x01" + b"\xfb\xef\xff" * 86) + number * 7)
    part = lambda b: len(b).to_bytes(4, "big") + b
    ssh = secrets.SSH_MAGIC + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(noise(51)) + part(noise(148))
    patterns = secrets.compiled()
    fold = lambda t, n, by="\n": by.join(t[a:a + n] for a in range(0, len(t), n))
    std, url = base64.b64encode(key).decode(), base64.urlsafe_b64encode(key).decode()
    assert "-" in url and "_" in url
    armour = lambda body, head="": f"-----BEGIN RSA PRIVATE KEY-----\n{head}{fold(body, 64)}\n-----END RSA PRIVATE KEY-----\n"
    pem64 = base64.b64encode(armour(std).encode()).decode()
    locked = armour(base64.b64encode(noise(608)).decode(), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n")
    ssh64 = base64.b64encode(ssh).decode()
    for secret, kind in ((url, "der_key"), (fold(std, 64), "der_key"), (fold(url, 76, "\r\n"), "der_key"), (fold(ssh64, 64), "ssh_key"), (fold(std, 64, "\n  "), "der_key"),
                         (fold(ssh64, 76), "ssh_key"), (pem64, "pem_key"), (fold(pem64, 76), "pem_key"), (locked, "pem_key"), (armour(std, "X-Note: a-b\n\n"), "pem_key")):
        for text in (f"see {secret.strip()} end", f"keys:\n{secret.strip()}\nThanks\nall"):
            spans = secrets.structural_spans(text, patterns)
            a = text.index(secret.strip())
            assert any(s == a and secrets.KINDS[k] == kind and a + len(secret.strip().rstrip("=")) <= e <= a + len(secret.strip()) for s, k, e in spans), (kind, secret[:40], spans, a, len(secret))
    glued = f"name-{url}"
    assert [(a, b) for a, _, b in secrets.structural_spans(glued, patterns)] == [(5, len(glued))]
    broken = locked.replace("Proc-Type", "Note")
    assert not secrets.structural_spans(broken, patterns) and not secrets.structural_spans(fold(base64.b64encode(noise(900)).decode(), 64), patterns)


def test_secrets_base_against_loop(documents, texts, awkward, empty):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for r in secrets.scan(documents).collect():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(texts[r.doc_id]) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", texts[r.doc_id]) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", texts[r.doc_id]) if len(m[0]) >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.n_hex == sum(k == 2 for _, k, _ in found)
    rows = secrets.scan(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.spans for r in rows} == {""} and secrets.scan(empty).count() == 0
    assert secrets.redact_secrets(awkward).columns == awkward.columns


# pages


def test_extraction_on_pages_and_variants(spark):
    prepare(spark)
    pages = table(spark, SF, "pages")
    model = extraction.learn(pages)
    source = {r.page_id: r.html for r in pages.collect()}
    spare = [p for page in source.values() for p in re.findall(r"<p>([^<]{3,200})</p>", page)]
    rng = np.random.default_rng(8)
    for r in extraction.extract(pages, model).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.DOTALL)[1]
        blocks = [re.sub(r"<[^>]*(?:>|\Z)", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = [" ".join(extraction.html.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)
        order = extraction.in_order(extraction.parse(extraction.variant(source[r.page_id], spare, rng)))
        gold = {id(n) for n in order if n.label and n.tag not in extraction.DROPPED}
        got = extraction.decode(order, model.predict(extraction.features(order).astype(float)))
        assert extraction.text_of(order[0], got) == extraction.text_of(order[0], gold)


def test_decoding_is_consistent():
    order = extraction.in_order(extraction.parse("<div><article><p>a</p><div><p>b</p></div></article><p>c</p></div>"))
    rng = np.random.default_rng(0)
    for _ in range(50):
        inside = extraction.decode(order, rng.random(len(order)))
        for node in order:
            up = node.parent
            while id(node) in inside and up is not None and id(up) not in inside:
                assert not any(id(a) in inside for a in ancestors(up))
                up = up.parent


def ancestors(node):
    while node.parent is not None:
        node = node.parent
        yield node


def test_extraction_goes_on_after_raw_elements():
    def text(page):
        root = extraction.parse(page)
        return extraction.text_of(root, {id(n) for n in extraction.in_order(root)})

    assert text("<p>a</p><script>x = '<!--'</script><p>the article</p>") == "a\nthe article"
    assert text("<script>if (i<n) {} // don't\n</script><p>it <b>isn't</b> lost > here</p>") == "it isn't lost > here"
    assert text("<p>a</p><style>p {}</style>the last text") == "a\nthe last text"
    assert text("<p>a</p><script>never closed <p>b</p>") == "a"


def test_extraction_places_of_many_siblings():
    order = extraction.in_order(extraction.parse("".join(f"<p>{'x' * (k + 1)}</p>" for k in range(100))))
    x = extraction.features(order)[1:]
    assert np.allclose(x[:, 9], np.arange(100) / 100)
    assert np.allclose(x[1:, 10], np.log1p(np.arange(1, 100))) and np.allclose(x[:-1, 11], np.log1p(np.arange(2, 101))) and x[0, 10] == x[-1, 11] == 0


def test_extraction_awkward(spark):
    prepare(spark)
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>open <b>no end &amp"), (4, "u", "plain &lt; text"), (None, "u", "<div" + "<div>" * 3000), (3, "u", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract(pages, None).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, 2, 4)] == ["", "", "plain < text"]
    assert "open no end &" in [r.text for r in got if r.page_id == 3]
    assert extraction.extract(pages.filter("false"), extraction.learn(pages.filter("false"))).count() == 0


# near duplicates


def shingles(text, size):
    words = words_of(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def groups_by_force(texts, size, a, b):
    ids, sets = sorted(texts), {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and b * len(sets[x] & sets[y]) >= a * len(sets[x] | sets[y]):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("size, share", [(3, (85, 100)), (5, (80, 100))])
def test_neardup_against_all_pairs(spark, texts, size, share):
    rng = np.random.default_rng(5)
    made, base = dict(texts), [f"w{k}" for k in range(120)]
    for k in range(80):  # a large group of near copies with links of many strengths
        words = list(base)
        for place in rng.integers(0, len(words), rng.integers(0, 7)):
            words[place] = f"x{rng.integers(1000)}"
        made[10_000 + k] = " ".join(words)
    frame = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.link_groups(frame, size, share).collect()}
    assert got == groups_by_force(made, size, *share)


def test_neardup_awkward(awkward, empty):
    got = sorted(neardup.link_groups(awkward).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles))
    seen = [(r.doc_id, r.component_id, r.kept) for r in got]
    assert seen == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 7, False), (8, 7, False), (9, 9, True), (None, None, True)]
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    assert neardup.link_groups(empty).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)], "a long, b long")
    assert {r.node: r.root for r in neardup.components(links).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


# conversations


def test_chat_reads_back(spark):
    prepare(spark)
    rows = chat.with_control_strings(spark, table(spark, SF, "conversations"))
    source = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn)):
        source[r.conv_id].append((r.role, r.text or ""))
    got = chat.digests(chat.format_conversations(rows)).collect()
    assert len(got) == len(source)
    for r in got:
        turns = source[r.conv_id]
        said = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_chat_typed_parts_and_pieces(spark, monkeypatch):
    prepare(spark)
    parts = [{"type": "text", "text": "see [IMAGE 0] \\ </s>"}, {"type": "image", "uri": "a.png", "width": 56, "height": 30}, {"type": "audio", "uri": "b.wav", "seconds": 2.0},
             {"type": "document", "uri": "c.pdf", "pages": 3}]
    full = [{f.name: p.get(f.name) for f in chat.PART_TYPE.elementType.fields} for p in parts]
    frame = spark.createDataFrame([(1, 0, "user", full), (1, 1, "assistant", None), (None, None, None, [])], f"conv_id long, turn long, role string, text {chat.PART_TYPE.simpleString()}")
    row = next(r for r in chat.format_conversations(frame).collect() if r.conv_id == 1)
    assert [(a.number, a.kind, a.uri, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 2100)]
    assert row.expanded_tokens == 2154 and row.formatted[row.attachments[1].position:].startswith("[AUDIO 1]")
    assert chat.read_turns(row.formatted)[0] == ("user", "see [IMAGE 0] \\ </s>[IMAGE 0][AUDIO 1][DOCUMENT 2]")
    monkeypatch.setattr(chat, "PIECE_CHARS", 40)
    many = spark.createDataFrame([(5, k, "assistant", f"turn {k} </s>") for k in range(30)], "conv_id long, turn long, role string, text string")
    pieces = chat.format_conversations(many)
    assert pieces.count() > 5
    got = chat.digests(pieces).first()
    assert got.n_turns == 30 and got.loss_sha256 == hashlib.sha256("".join(f"turn {k} </s>" for k in range(30)).encode()).hexdigest()
    assert chat.format_conversations(many.filter("false")).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "</s>", "<\\/s>", "[INST]", "[\\INST]", "<<s>", "<|x|>", "[IMAGE 3]", "\n\\\n", "<<SYS>>"])
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text and not re.search(r"</?s>|\[/?(?:ROLE|INST)\]|<\||\[IMAGE \d", chat.escape(text))


# models


def folds(documents):
    return [(r.doc_id, r.text or "", zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in documents.collect()]


def test_language_prior(spark):
    """Equal evidence leaves the shares of the languages in the corpus."""
    rows = [(i, "abc def", "aa" if i % 10 else "bb") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, matrix = language.learn(frame)
    assert names == ["aa", "bb"] and np.allclose(np.exp(matrix[-1]), [0.9, 0.1]) and matrix.shape == (language.BUCKETS + 1, 2)
    assert np.isclose(np.exp(matrix[:-1].astype(float)).sum(axis=0), 1, atol=1e-4).all()
    assert {r.lang_pred for r in language.predict(frame, names, matrix).collect()} == {"aa"}


def test_language_held_out(spark, documents, awkward, empty):
    names, matrix = language.learn(documents.filter(~language.held_out()))
    got = {r.doc_id: r for r in language.predict(documents, names, matrix).collect()}
    lang = {r.doc_id: r.lang for r in documents.collect()}
    out = [i for i, _, h in folds(documents) if h]
    assert all(got[i].held_out == h for i, _, h in folds(documents))
    assert np.mean([got[i].lang_pred == lang[i] for i in out]) >= 0.97
    said = {r.doc_id: r.lang_pred for r in language.predict(awkward, names, matrix).collect()}
    assert said[1] == said[2] == said[3] == "und" and len(said) == 10
    texts = [None, "", "1 2", "añb", "xyz " * 9000] + [r.text for r in documents.limit(90).collect()]
    logits, lettered = language.logits_of(texts, matrix)
    for text, row, known in zip(texts, logits, lettered):  # a plain sum over the n-grams, after the prior
        points = [c if chr(c).isalpha() else 0 for c in map(ord, f"\n{(text or '').lower()}\n")]
        assert known == any(points)
        if len(points) < 3000:
            want = matrix[-1].astype(float)
            for n in language.ORDERS:
                for a in range(len(points) - n + 1):
                    gram = np.array(points[a:a + n], np.uint32)
                    if gram[0] or gram[-1]:
                        mixed = 0
                        for c in gram.tolist():
                            mixed = (mixed * 0x9E3779B1 + c + 1) % 2 ** 32
                        want = want + matrix[(mixed * 0x85EBCA6B % 2 ** 32) >> 18]
            assert np.allclose(row, want, rtol=1e-6)
    none, blank = language.learn(empty)
    assert {r.lang_pred for r in language.predict(awkward, none, blank).collect()} == {"und"} and language.predict(empty, names, matrix).count() == 0


def test_network_gradients():
    from gapscope.llm import bigru
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in bigru.new_parameters(4, 3).items()}
    x, mask = rng.normal(size=(5, 6, 4)), np.sort((rng.random((5, 6)) < 0.8), axis=0)[::-1].astype(float)
    mask[0] = 1
    target, weight = (rng.random(6) < 0.5).astype(float), np.ones(6)
    _, grads = bigru.gradients(p, x, mask, target, weight)
    for name in p:
        at = tuple(int(rng.integers(0, s)) for s in p[name].shape)
        ends = []
        for step in (1e-3, -1e-3):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            ends.append(bigru.gradients(q, x, mask, target, weight)[0])
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(float(grads[name][at]), abs=2e-4)


def test_toxicity_learns_planted_words(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    plain, bad = [f"word{k}" for k in range(400)], ["vilest", "rotten", "wretch"]
    rows = []
    for i in range(600):
        words = [plain[k] for k in rng.integers(0, 400, rng.integers(5, 150))]
        toxic = int(i % 3 == 0)
        if toxic:
            for place in rng.integers(0, len(words), 2):
                words[place] = bad[rng.integers(3)]
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, y in out]) >= 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity.keep_clean(docs, model).count() == sum(not r.predicted for r in got.values())


def test_toxicity_reads_whole_runs():
    rng = np.random.default_rng(2)
    for n in (47, 48, 49, 92, 93, 200, 1000):
        run = "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 20_000, n))
        for text in (run, f"«{run}».", run[:n // 2] + "_-/." * 3 + run[n // 2:]):
            words = toxicity.split_words(f"a {text} b")
            core = text.strip(toxicity.STRIP).lower()
            pieces = [w.removeprefix(toxicity.PIECE).strip(toxicity.STRIP if w[:1] != toxicity.PIECE else "") for w in words[1:-1]]
            assert max(map(len, pieces)) <= toxicity.LONGEST
            assert {core[a:a + g] for g in (1, 3, 4, 5) for a in range(len(core) - g + 1)} == {p[a:a + g] for p in pieces for g in (1, 3, 4, 5) for a in range(len(p) - g + 1)}
            assert len(toxicity.vectors(words, {k: np.zeros(toxicity.BUCKETS, np.float32) for k in ("word", "gram")})) == len(words)
    assert toxicity.split_words("plain words, here") == ["plain", "words,", "here"]
    plain = lambda: "".join(chr(0x5E00 + int(k)) for k in rng.integers(0, 300, 60))
    mark = "\u6bd2" * 5
    texts = [plain() + (mark if i % 4 < 2 else "") + plain() for i in range(600)]
    scorer = toxicity.Scorer(toxicity.train(texts, [int(i % 4 < 2) for i in range(600)]))
    assert (scorer.score([plain() + mark + plain() for _ in range(20)]) > 0.5).all() and (scorer.score([plain() + plain() for _ in range(20)]) < 0.5).all()


def test_toxicity_windows_cover_every_word_and_awkward_rows(awkward, empty, spark):
    doc, first, length = toxicity.window_places(np.array([0, 1, 32, 33, 100]))
    for d, n in enumerate([0, 1, 32, 33, 100]):
        covered = {w for dd, f, k in zip(doc, first, length) if dd == d for w in range(f, f + k)}
        assert covered == set(range(n))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(awkward, labels)
    assert toxicity.score(awkward, model).count() == len(AWKWARD) and toxicity.score(empty, model).count() == 0


# rules


def test_rule_counts_against_loop(documents, texts, awkward, empty):
    def want(text):
        words, seen, covered = words_of(text), defaultdict(list), set()
        for i in range(len(words) - 7):
            seen[tuple(words[i:i + 8])].append(i)
        for places in seen.values():
            if len(places) > 1:
                covered |= {i + k for i in places for k in range(8)}
        lines = [x for x in text.split("\n") if words_of(x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)

    def got(r):
        return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words

    for r in rules.judge(documents, []).collect():
        assert got(r) == want(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    by_id = {r.doc_id: r for r in rules.judge(awkward, []).collect()}
    for i, text in AWKWARD:
        assert got(by_id[i]) == want(text or "")
    assert rules.judge(empty, []).count() == 0


def test_rules_are_learned_and_native(spark, documents):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        bad = i % 2 == 0
        row = dict.fromkeys(rules.FEATURES, 0.0) | {"mean_word": float(rng.normal(5, 0.3)), "symbol_ratio": float(rng.uniform(1, 3)) if bad else float(rng.uniform(0, 0.1))}
        rows.append((row, bad))
    found = rules.learn_list(rows)
    assert found and all(any(rules.fires(r, row) for r in found) == bad for row, bad in rows)
    learned = rules.learn(documents, table(spark, SF, "labels"))
    plan = rules.judge(documents, learned)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    verdicts = {r.doc_id: r for r in rules.judge(documents, learned).collect()}
    clean = [i for i, q in labels.items() if q == 1 and i in verdicts and not verdicts[i].base_failed]
    assert np.mean([verdicts[i].kept for i in clean]) >= 0.95


# decontamination


def test_leaks_found_and_paraphrased(spark, documents, texts):
    benchmark = table(spark, SF, "benchmark")
    items = {r.item_id: r.text for r in benchmark.collect()}
    planted = dict(texts)
    some = sorted(items)[:6]
    filler = " ".join(w for i in sorted(texts)[:3] for w in words_of(texts[i])[:40])
    for k, i in enumerate(some):
        words = words_of(items[i])
        planted[90_000 + k] = f"{filler} {' '.join(words)} {filler}"
        planted[91_000 + k] = f"{filler} {' '.join('zzz' if j % 7 == 3 else w for j, w in enumerate(words))} {filler}"
    frame = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, benchmark).collect()}
    exact = {(d, i) for d, t in planted.items() for i, x in items.items() if f" {' '.join(x.split())} " in f" {' '.join(t.split())} "}
    assert exact <= got and all((91_000 + k, i) in got for k, i in enumerate(some))
    for d, i in got - exact:  # everything else holds most of the item in order
        a, b = words_of(items[i].lower()), words_of(planted[d].lower())
        assert lcs([w.strip(".,!|#$%&*") for w in a], [w.strip(".,!|#$%&*") for w in b]) >= decontamination.LEAST_COMMON * len(a) * 0.9
    kept = {r.doc_id for r in decontamination.drop_leaks(frame, benchmark).collect()}
    assert kept == set(planted) - {d for d, _ in got}


def test_leaks_with_more_items_than_dimensions():
    """The same as all items against all regions, with a space far too small for the items."""
    rng = np.random.default_rng(8)
    vocabulary = (rng.integers(1, 1 << 62, 3000).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    names = {int(h): f"w{k}" for k, h in enumerate(vocabulary)}
    texts = [" ".join(names[int(vocabulary[k])] for k in rng.zipf(1.3, 300) % 3000) for _ in range(12)]
    hashes = [neardup.word_hashes([t], decontamination.PUNCTUATION)[0].tolist() for t in texts]
    items, copies = [], set()
    for n in [3, 8, 10, 12, 15, 20, 30, 48, 64, 65, 90, 150] * 25:
        d, a = int(rng.integers(12)), int(rng.integers(0, 300 - n))
        words = hashes[d][a:a + n]
        copies.add((d, len(items)))
        items.append((len(items), words, min(4, n)))
        damaged = [int(vocabulary[0]) if rng.random() < 0.35 else w for w in words]
        items.append((len(items), damaged, min(4, n)))
    weights = rng.gamma(0.5, 1.0, decontamination.BUCKETS).astype(np.float32) + np.float32(0.01)
    basis = np.linalg.qr(rng.standard_normal((decontamination.BUCKETS, 24)))[0].astype(np.float32)
    searcher = decontamination.Searcher(weights, basis, items)
    got = {(t, i): (common, said) for t, i, _, common, said, _ in searcher.search(texts)}
    want = {}
    for t, words in enumerate(hashes):
        for i, item, answer in items:
            n = len(item)
            size, step = (n, 1) if n < decontamination.SHORT_ITEM else (math.ceil(1.5 * n), max(1, n // 8))
            whole, ending = searcher.masks[i]
            weight = [float(weights[h >> 50]) for h in item]
            for start in range(0, len(words), step):
                span = words[start:start + size]
                common, said = decontamination.common_words(whole, n, span) / n, decontamination.common_words(ending, answer, span) / answer
                if common == 1 if n < decontamination.SHORT_ITEM else common >= 0.8 or (common >= 0.6 and said >= 0.5):
                    if n < decontamination.SHORT_ITEM or heaviest(item, span, weight) >= 0.5 * sum(weight) - 1e-9:
                        want[t, i] = max(want.get((t, i), (0, 0)), (common, said))
    assert copies <= set(want) and got == want


def test_latent_space_is_fitted_on_every_document(spark):
    """2,600 documents, two windows each: the product is that of all their passages, and one product gives about as good a basis as two."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.2, 90) % 500) for _ in range(2600)] + [None, "", "?"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = [(neardup.word_hashes([" ".join(f"w{k}" for k in range(a, a + 20))], decontamination.PUNCTUATION)[0], 0) for a in (0, 40)]
    blocks = decontamination.word_buckets(rows)
    weights, total = decontamination.document_weights(blocks)
    assert total == len(texts)
    product = decontamination.document_product(blocks, weights)
    passages = [h for t in texts if t for h in np.split(decontamination.buckets_of(neardup.word_hashes([t], decontamination.PUNCTUATION)[0]), [64]) if len(h)]
    seen = sum(np.isin(np.arange(decontamination.BUCKETS), np.concatenate(p)) for p in zip(passages[0::2], passages[1::2]))
    assert np.allclose(weights, (np.log((len(texts) + 1) / (seen + 1)) + 0.05) ** decontamination.POWER, rtol=1e-5)
    met, dense = np.unique(np.concatenate(passages)), []
    for p, scale in [(p, 1.0) for p in passages] + [(decontamination.buckets_of(h), decontamination.ITEM_WEIGHT) for h, _ in items]:
        row = np.bincount(p, weights[p], decontamination.BUCKETS)[met]
        dense.append(row * scale / math.sqrt((weights[p].astype(float) ** 2).sum()))
    dense = np.array(dense)
    documents, looked = dense[:len(passages)], decontamination.directions()[met]
    assert np.allclose(product[met], documents.T @ (documents @ looked), atol=1e-3 * np.abs(product).max())
    basis = decontamination.fit(product, items, weights)
    assert basis.shape == (decontamination.BUCKETS, decontamination.RANK) and np.allclose(basis.T @ basis, np.eye(decontamination.RANK), atol=1e-4)
    span = np.linalg.qr(dense.T @ (dense @ looked))[0]  # with a second product, the best basis within the same span
    best = (np.linalg.svd(dense @ span, compute_uv=False)[:decontamination.RANK] ** 2).sum()
    assert np.square(dense @ basis[met]).sum() > 0.98 * best


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def heaviest(a, b, weight):
    row = [0.0] * (len(b) + 1)
    for x, w in zip(a, weight):
        last = 0.0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + w if x == y else 0.0)
    return row[-1]


EVERYDAY = [
    "In the morning the name on the door was the first thing we saw, and it is still there today. The keys were in the hall, and a "
    "map of the coast lay on the table next to the letters. The road to the river is closed in winter, as everyone in the village "
    "knows. What the driver told us about it was of no use at all.",
    "When we asked how many people would come to the party, nobody in the office knew. There are a lot of chairs in the hall and the "
    "team of the kitchen is ready. How the guests get home in the night is another question, and the players of the band have to "
    "carry their things on foot.",
    "The war of words between the two neighbours did not end in that year. Who was right about the fence is hard to say, and the first "
    "of them to be asked was away. He said it was the president of the club who should decide on the matter in the United Kingdom.",
]
QUESTIONS = [
    "What is the name of the river in Egypt?",
    "How many players are there in a team of football?",
    "Who was the first president of the United States?",
    "What is the capital of Australia? The capital of Australia is Canberra.",
    "At what temperature does water boil at sea level? It boils at one hundred degrees Celsius.",
]


def test_leaks_leave_everyday_prose_alone(spark):
    """Ordinary questions hit no text that merely uses the same small words; copies and paraphrases of them are found."""
    documents = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    made = [(900_000 + k, text) for k, text in enumerate(EVERYDAY)]
    held = [(910_000 + k, f"{EVERYDAY[0]} {q.replace('?', '')} {EVERYDAY[1]}") for k, q in enumerate(QUESTIONS)]
    held.append((920_000, f"{EVERYDAY[2]} Name the capital of Australia. The capital city of Australia is Canberra. {EVERYDAY[1]}"))
    frame = documents.unionByName(spark.createDataFrame(made + held, "doc_id long, text string"))
    benchmark = spark.createDataFrame(list(enumerate(QUESTIONS)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, benchmark).collect()}
    assert got == {(910_000 + k, k) for k in range(len(QUESTIONS))} | {(920_000, 3)}


def test_bit_parallel_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 70)).tolist(), rng.integers(0, 6, rng.integers(0, 90)).tolist()
        assert decontamination.common_words(decontamination.masks_of(a), len(a), b) == lcs(a, b)
        if a:
            weight = rng.random(len(a))
            assert math.isclose(decontamination.common_weight(a, weight, b), heaviest(a, b, weight), abs_tol=1e-9)


def test_leaks_awkward(spark, awkward, empty):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "same text here again"), (4, "none of these words occur anywhere in it")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(awkward, benchmark).collect()}
    assert got == {(7, 3), (8, 3)}
    assert decontamination.find_leaks(empty, benchmark).count() == 0 and decontamination.find_leaks(awkward, benchmark.filter("false")).count() == 0


def test_word_hashes_split_like_the_pattern():
    texts = [x for _, x in AWKWARD] + ["A b\x0bC\x0cd\r\n E"]
    hashes, counts = neardup.word_hashes(texts)
    assert counts.tolist() == [len(words_of(t or "")) for t in texts]
    flat = [w.translate({c: c + 32 for c in range(65, 91)}) for t in texts for w in words_of(t or "")]
    by_word = defaultdict(set)
    for w, h in zip(flat, hashes.tolist()):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)
    assert math.isclose(neardup.table_width(0.85), 11)

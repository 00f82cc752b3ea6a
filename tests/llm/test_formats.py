"""Archives, chat templates, packing and fingerprints."""

import hashlib
import random
import struct
import zlib

import pytest

from rankloom.llm import chat_format, common, imatch, packing, template, warc_zip
from tests.llm import brute

# ---- archives ----


def reader(blob):
    return warc_zip.ZipDirectory(lambda at, n: blob[at:at + n], len(blob))


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directory(zip64):
    import io
    import zipfile
    members = [("a/b.bin", b"xyz" * 100), ("empty", b""), ("é.txt", b"PK\5\6" * 9)]
    blob = warc_zip.zip_bytes(members, zip64, comment=b"a PK\5\6 in the comment, long enough to look like an end")
    z = reader(blob)
    assert {n: z.read(n) for n in z.members} == dict(members)
    with zipfile.ZipFile(io.BytesIO(warc_zip.zip_bytes(members, zip64, b"plain comment"))) as std:    # a public reader agrees
        assert {n: std.read(n) for n in std.namelist()} == dict(members) and std.testzip() is None


def test_zip_of_a_public_writer():
    import io
    import zipfile
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"data" * 50)
        z.writestr("packed", "text", zipfile.ZIP_DEFLATED)
    z = reader(b"junk before" * 0 + out.getvalue())
    assert z.read("big") == b"data" * 50
    with pytest.raises(ValueError):
        z.read("packed")
    with pytest.raises(ValueError):
        reader(b"no archive" * 10)


def test_zip_checksum():
    blob = bytearray(warc_zip.zip_bytes([("m", b"payload")]))
    blob[blob.index(b"payload")] ^= 1
    with pytest.raises(ValueError):
        reader(bytes(blob)).read("m")


def test_pages_round_trip(spark, tmp_path):
    long_, short = "é" * 60, "x" * 99
    rows = [(5, "http://a/1", long_), (2, "http://a/2", long_), (9, None, long_), (1, "http://b/ x\r\nEvil: 1", short), (3, "u%20v", short),
            (4, "u", None), (6, "u", ""), (None, "n", long_), (7, "http://é/", "\r\n\r\nWARC/1.1\r\n" + "z" * 100000)]
    common.prepare(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", common.F.lit(1))
    packages = warc_zip.write_packages(warc_zip.classify(pages), str(tmp_path), package_bytes=200)
    assert packages.count() > 1
    got = {r.page_id: r for r in warc_zip.read_packages(packages).collect()}
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        r = got[page_id]
        data = (html or "").encode()
        revisit = html == long_ and page_id != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert r.payload_digest == hashlib.sha256(data).hexdigest() and r.url == url
        assert r.payload == (None if revisit else data)


def test_no_pages(spark, tmp_path):
    common.prepare(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zip.read_packages(warc_zip.write_packages(warc_zip.classify(pages), str(tmp_path))).count() == 0

# ---- templates ----


def test_template_language():
    t = template.compile_template(
        "{# note #}{%- set a = 1 + 2 -%} {{ a }}{% for x in xs %}{% if loop.first %}<{% elif x == 'b' or x in ys %}={% else %}-{% endif %}"
        "{{ x | upper ~ (1 if loop.last else none) }}{% endfor %}{{ m.k['z'] }}{{ missing.deep.er }}{% generation %}{{ 'é' }}{% endgeneration %}")
    text, spans = t(xs=["a", "b", "c"], ys=[], m={"k": {"z": "q"}})
    assert text == "3<A=B-C1qé" and spans == [(9, 10)]


def test_template_folding():
    node = template.fold(template.parse("a{% if 1 == 1 and not false %}b{{ 'c' + 'd' | upper }}{% else %}{{ x }}{% endif %}{% if false %}z{% endif %}"))
    assert [(p.kind, p.value) for p in node.parts] == [("text", "abcD")]


@pytest.mark.parametrize("bad", ["{{ __import__('os') }}", "{{ x.__class__() }}", "{% include 'x' %}", "{% if x %}", "{{ 'a' }", "{{ x | nofilter }}", "{{ 1 + 'a' }}"])
def test_template_sandbox(bad):
    if bad == "{{ 'a' }":
        assert template.compile_template(bad)()[0] == bad      # not a tag: plain text
        return
    with pytest.raises(template.TemplateError):
        template.compile_template(bad)(x={})


def test_template_attributes_reach_data_only():
    t = template.compile_template("{{ x.__class__ }}{{ x.upper }}{{ y[0] }}{{ y[9] }}")
    assert t(x="text", y=["a"])[0] == "a"
    with pytest.raises(template.TemplateError):
        template.compile_template("{{ raise_exception('no') }}")()


def test_escape_round_trip():
    r = random.Random(3)
    bits = ["\\", "<s>", "</s>", "[INST]", " [/INST]", "[ROLE]", "[TEXT]", "[/ROLE]", " ", "a", "[", "/", "\n", "s>", "<", "é"]
    render = template.compile_template(chat_format.TEMPLATE, {"escape": chat_format.escape})
    for _ in range(2000):
        said = [{"role": r.choice(["user", "assistant", "system", "tool", "", "\\", "[TEXT]"]), "text": "".join(r.choices(bits, k=r.randint(0, 7)))}
                for _ in range(r.randint(1, 5))]
        text, spans = render(messages=said, start=r.random() < .5)
        assert chat_format.read_back(text) == [(m["role"], m["text"]) for m in said]
        assert [chat_format.unescape(text[a:b]) for a, b in spans] == [m["text"] for m in said if m["role"] == "assistant"]


def test_conversations(spark, tmp_path):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", None), (2, None, None, "x"), (None, 0, "assistant", "</s>")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"t{i}\\") for i in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.withColumn("part", turns["turn"]).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat_format.op7_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    for conv in got:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        if conv == -1:
            mine = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = chat_format.format_conversations(turns).where("conv_id = 3").collect()
    assert len(parts) == 3 and sum(p.text.count("<s>") for p in parts) == 1


def test_no_conversations(spark):
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

# ---- packing ----


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_optimal(seed):
    r = random.Random(seed)
    points, costs = [0], [0]
    for _ in range(60):
        points.append(points[-1] + r.randint(1, 9))
        costs.append(r.choice([0, 0, 3, 7]))
    ends = packing.best_cuts(packing.np.array(points), packing.np.array(costs), 20, True)
    cost, last = 0, 0
    for e in ends:
        assert 0 < e - last <= 20
        cost += 20 - (e - last) + costs[points.index(e)]
        last = e
    assert last == points[-1] and cost == brute.best_padding(points, costs, 20)


def test_cut_points_of_long_sentences():
    at, cost = packing.cut_points([700, 10], [packing.np.array([5, 300], "<u4"), packing.np.array([10], "<u4")])
    assert at.tolist() == [0, 5, 261, 300, 556, 700, 710] and cost.tolist() == [0, 2, 64, 2, 64, 0, 0]


def check_pack(pieces, expect, length):
    assert {r.doc_id for r in pieces} == set(expect)
    for doc, rows in brute.by_key(pieces, lambda r: r.doc_id).items():
        ids, at = expect[doc], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    for rows in brute.by_key(pieces, lambda r: r.sequence_id).values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length


def token_ids(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    return {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}


def test_packing(docs_of, monkeypatch):
    r = random.Random(1)
    odd = [None, "", " ", "\x1f a\x1fb \x1f", "x<|endoftext|>y z", "é é     ΑΣ it's 123 ...!!", "don't STOP", "日本語 テスト", "a" * 5000]
    rows = list(enumerate(odd)) + [(100 + i, " ".join(r.choices(["Word", "thing.", "of", "x9", "(ok)"], k=r.randint(1, 900)))) for i in range(40)]
    rows += [(-5, "negative id."), (10**15, "far away.")]
    monkeypatch.setattr(packing, "CHUNK_TOKENS", 3000)
    pieces = packing.pack(docs_of(rows, extra=True), packing.tokenizer_path(), 256, block_docs=16).collect()
    check_pack(pieces, token_ids(rows), 256)
    assert packing.pack(docs_of([]), packing.tokenizer_path()).count() == 0
    twice = packing.pack(docs_of([(1, "a b"), (1, "a b"), (None, "c"), (None, None)]), packing.tokenizer_path()).collect()
    assert sum(p.length for p in twice) == 3 + 3 + 2 + 1


def test_word_cache_forgets(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    enc = packing.WordEncoder(packing.tokenizer_path())
    for text in (b"a b c d e", b"f g a.b", b"a f z"):
        ids, size = enc.ids(packing.Words([text]))
        assert ids.tolist() + [1] == token_ids([(0, text.decode())])[0] and size.sum() == len(ids)

# ---- fingerprints ----


def test_fingerprints(docs_of):
    r = random.Random(2)
    vocab = [f"f{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(30, 200)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "é"), (53, rows[3][1]), (54, rows[3][1]), (None, "last one"), (55, "w " * 30000)]
    got = imatch.edited_likeness(docs_of(rows, extra=True), band=(0.5, 9.0)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: (x[0] is None, x[0]))
    by = {r.doc_id: r for r in got}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert (by[i].n_chars, by[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= by[i].near_edited <= 1 and 0 <= by[i].near_next <= 1
    assert by[53].fingerprint == by[54].fingerprint == by[3].fingerprint and by[53].near_next == 1
    assert by[50].fingerprint == by[51].fingerprint
    long_ = [by[i] for i in range(40)]
    assert sum(x.near_edited for x in long_) > 3 * sum(x.near_next for x in long_)


def test_fingerprints_of_one_and_none(docs_of):
    assert imatch.edited_likeness(docs_of([])).count() == 0
    one = imatch.edited_likeness(docs_of([(7, "alone here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    nulls = imatch.edited_likeness(docs_of([(None, "a"), (None, "bb"), (None, None)])).collect()
    assert sorted(r.n_chars for r in nulls) == [0, 1, 2]


def test_fingerprints_over_many_ranges(docs_of, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_DOCS", 5)
    rows = [(i * 3, f"text number {i} " * (i % 9)) for i in range(83)]
    got = {r.doc_id: r for r in imatch.edited_likeness(docs_of(rows)).collect()}
    assert len(got) == 83
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()

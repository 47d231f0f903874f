import hashlib

import pytest

from veritrail.operators.chunking import chunk_markdown, frontmatter, sections
from veritrail.operators.evidence import evidence_units, with_evidence_units
from veritrail.sources import markdown as md

PAGE = "﻿---\ncategory: skills\n---\n# Anna Example\n\nIntro text here.\n\n## Skills\n\n- Spark\n- SQL\n\n```\n# not a heading\n```\n\n## Empty\n\n### Deep\n\nDeep text.\n"


def test_sections_and_offsets():
    body = PAGE.lstrip("﻿")
    assert frontmatter(body) == (1, 3) and frontmatter("---\nopen") is None and frontmatter("x\n---\n---") is None
    found = sections(PAGE)
    assert [(s.name, s.level) for s in found] == [("Anna Example", 1), ("Anna Example > Skills", 2), ("Anna Example > Empty > Deep", 3)]
    rows = chunk_markdown(PAGE, "cv/anna.md")
    for chunk_id, file, section, text, path, level, first, last, start, end, ordinal in rows:
        assert body[start:end] == text
        assert body.splitlines()[first - 1].strip() == text.splitlines()[0] and file == "cv/anna.md"
        digest = hashlib.sha256(f"{file}\0{section}\0{ordinal}\0{text}".encode()).hexdigest()[:12]
        assert chunk_id == f"anna-{ordinal:04d}-{digest}"


@pytest.mark.parametrize("size,overlap", [(120, 30), (400, 60), (80, 0)])
def test_chunks_overlap_and_lose_nothing(size, overlap):
    text = " ".join(f"Sentence number {k} says a thing." for k in range(200)) + "\n\n" + "x" * 500
    rows = chunk_markdown(text, "a.md", size, overlap)
    assert all(len(r[3]) <= size for r in rows)
    covered = set()
    for a, b in zip(rows, rows[1:]):
        assert b[8] <= a[9] or overlap == 0 or "x" in b[3]
        covered |= set(range(a[8], a[9]))
    covered |= set(range(rows[-1][8], rows[-1][9]))
    assert all(k in covered or c.isspace() for k, c in enumerate(text))
    with pytest.raises(ValueError):
        chunk_markdown("x", "a.md", 10, 10)
    assert chunk_markdown("", "a.md") == [] and chunk_markdown("# only\n\n## headings\n", "a.md") == []


def test_evidence_units(spark):
    text = "# H\n\nFirst fact. Second has 9.11. Eric E. Huerta is one.\n\n- Bullet **bold**\n  goes on\n- Next\n\n| Name | Value |\n|---|---|\n| a | b | c |\n| d |\n\n**What is it?**\n9.11. It is so.\n"
    units = evidence_units(text)
    assert [(u["text"], u["prompt"], u["is_list_item"]) for u in units] == [
        ("First fact.", None, False), ("Second has 9.11. Eric E. Huerta is one.", None, False), ("Bullet bold goes on", None, True), ("Next", None, True),
        ("a: b; c", None, False), ("d", None, False), ("9.11. It is so.", "What is it?", False),
    ]
    df = with_evidence_units(spark.createDataFrame([(text,), (None,), ("",)], "text string"))
    assert [len(r["units"]) for r in df.collect()] == [7, 0, 0]


def test_corpus_source(spark, tmp_path):
    for name in ("b.md", "_x.md", ".hidden.md", "drafts/d.md", "sub/a.MARKDOWN", "note.txt", "sub/exports/e.md", "t.tmp.md", "bak.md~"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(PAGE.encode())
    assert md.list_files(str(tmp_path)) == ["_x.md", "b.md", "sub/a.MARKDOWN"]
    assert md.list_files(str(tmp_path / "none")) == []
    files = md.read_files(spark, str(tmp_path))
    sha = lambda data: hashlib.sha256(data).hexdigest()
    groups = {}
    for path in md.list_files(str(tmp_path)):
        groups.setdefault(sha(path.encode())[:3], []).append(f"{path}\0{sha(PAGE.encode())}\n")
    expected = sha("".join(f"{g} {sha(''.join(sorted(lines)).encode())}\n" for g, lines in sorted(groups.items())).encode())
    assert md.fingerprint(files) == expected == md.fingerprint(files.repartition(3)) and md.fingerprint(files.limit(0)) == sha(b"")
    chunks = md.load_chunks(files)
    rows = chunks.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(9)) and [r.source_file for r in rows] == sorted(r.source_file for r in rows)
    vectors = chunks.selectExpr("position", "array(1.0f, 0.0f) as vec")
    described = md.manifest(files, chunks, "test", 2)
    index = str(tmp_path / "index")
    (tmp_path / "index").mkdir()
    assert md.load_index(spark, index, described) is None
    assert md.save_index(chunks, vectors, index, described)
    stored, _ = md.load_index(spark, index, described)
    assert stored.count() == 9
    assert md.load_index(spark, index, described | {"dimension": 3}) is None
    with pytest.raises(ValueError):
        md.save_index(chunks, vectors.limit(1), index, described)
    for wrong in ("array(1.0f)", "array(1.0f, float('nan'))", "array(1.0f, null)"):
        odd = chunks.selectExpr("position", f"if(position = 3, {wrong}, array(1.0f, 0.0f)) as vec")
        with pytest.raises(ValueError, match="one width and finite"):
            md.save_index(chunks, odd, index, described)


@pytest.mark.parametrize("size, overlap", [(12, 11), (12, 10), (2, 1), (1, 0), (40, 39)])
def test_overlaps_that_leave_no_room_still_end(size, overlap):
    text = "# A\n\nSome words. More words here, and  spaces.\n\n" + "word " * 40 + "\n\n" + "x" * 90
    rows = chunk_markdown(text, "a.md", size, overlap)
    assert 0 < len(rows) < 2 * len(text)
    assert all(row[3] for row in rows) and "".join(text.split())[-1] == rows[-1][3][-1]

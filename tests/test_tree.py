"""The file source: every file once, reasons in order, files that fail."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lodestone.plans.lineage import cut
from lodestone.sources import tree

FILES = {
    ".env": b"A=1\n", ".npmrc": b"x", ".gitlab-ci.yml": b"a: 1", "_x.py": b"y = 1", "a.py": "é\n".encode(), "a/b/c/.hidden/d.go": b"package d", "a/b/e.PNG": b"\x89", "a/f.tf": b"", "a/g.bin": b"ab\0c",
    "a/late.txt": b"z" * 9000 + b"\0", "big.py": b"#" * 3000, "node_modules/x.js": b"1", "a/node_modules/.git/y.py": b"1", ".git/config": b"1", "bad.c": b"\xff\xfe!", "n.unknown": b"?", "Dockerfile.dev": b"FROM a", "q.rb": b"1",
}


@pytest.fixture
def root(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for i in range(30):
        (tmp_path / f"m{i:02}/n").mkdir(parents=True)
        (tmp_path / f"m{i:02}/n/f.py").write_bytes(b"pass\n")
    os.symlink(tmp_path / "nothing", tmp_path / "gone.py")
    os.symlink(tmp_path / "a", tmp_path / "a" / "circle")
    os.symlink("/proc/self/mem", tmp_path / "unreadable.py")  # a file whose first byte cannot be read, by anyone
    return tmp_path


def walked(root, excluded):
    """What a loop over the folders finds."""
    out = {}
    for folder, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d not in excluded]
        for n in names:
            p = os.path.join(folder, n)
            out[os.path.relpath(p, root)] = os.path.getsize(p) if os.path.exists(p) else None
    return out


@pytest.mark.parametrize("shares", [1, 3, 64])
def test_every_file_once(spark, root, shares):
    rows = tree.listed(spark, str(root), ("node_modules", ".git"), shares).collect()
    assert {r.path: r.length for r in rows} == walked(root, ("node_modules", ".git")) and len(rows) == len({r.path for r in rows})
    assert {r.path for r in rows if r.failed} == {"gone.py"}
    assert tree.listed(spark, str(root / "nowhere")).count() == 0
    if shares > 3:
        df = tree.listed(spark, f"file://{root}", ("node_modules", ".git"), shares)
        assert df.count() == len(rows) and df.select(F.spark_partition_id()).distinct().count() > 3


def test_reasons(spark, root):
    got = {r.path: r for r in tree.discover(spark, str(root), 2000, categories=("code", "config"), languages=("python", "go", "c"), binary_suffixes=(".png",)).collect()}
    assert set(got) == set(walked(root, (".git", "node_modules", "__pycache__")))
    reasons = {p: r.skip_reason for p, r in got.items() if r.skip_reason}
    assert reasons == {"a/b/e.PNG": "binary_ext", "a/f.tf": "category_excluded", ".gitlab-ci.yml": "category_excluded", "Dockerfile.dev": "category_excluded", "q.rb": "language_excluded", "gone.py": "stat_error", "big.py": "too_large", "a/late.txt": "too_large", "a/g.bin": "binary", "unreadable.py": "read_error"}
    for p, r in got.items():
        if not r.skip_reason:
            content = FILES.get(p, b"pass\n")
            assert (r.text, r.length, r.sha256) == (content.decode("utf-8", "replace"), len(content), hashlib.sha256(content).hexdigest())
    assert (got[".env"].language, got[".npmrc"].language, got[".gitlab-ci.yml"].language) == ("dotenv", "npmrc", "gitlabci")
    assert got["n.unknown"].category == "code"
    some = {r.path: r.skip_reason for r in tree.discover(spark, str(root), scan_unknown=False).collect()}
    assert some["n.unknown"] == some["a/late.txt"] == "unsupported_type"


def test_a_file_that_vanishes(spark, root):
    files = cut(tree.listed(spark, str(root), (".git", "node_modules")).filter("not failed"))
    (root / "a.py").unlink()
    got = {r.path: r.content for r in tree.with_contents(files, str(root), task_bytes=20_000).collect()}
    assert len(got) == files.count() and got["a.py"] is None and got["unreadable.py"] is None and got[".env"] == b"A=1\n"

"""Artefacts of a snapshot: a folder damaged in each way gives a row for each."""

import hashlib

from dossier.sources import artifacts


def test_a_folder_damaged_in_each_way(spark, tmp_path):
    root = tmp_path / "snap shot"
    (root / "sub").mkdir(parents=True)
    names = ["sound.txt", "sub/sound.bin", "gone.txt", "longer.txt", "other.txt", "twice.txt", "link.txt"]
    for n in names:
        (root / n).write_bytes(n.encode())
    listed = artifacts.manifest(spark, str(root))
    rows = [tuple(r) for r in listed.collect()]
    assert sorted(rows) == sorted((n, len(n), hashlib.sha256(n.encode()).hexdigest()) for n in names)
    said = spark.createDataFrame(rows, "path string, n_bytes long, sha256 string")
    assert artifacts.verify(spark, said, str(root)).isEmpty() and artifacts.verify(spark, said, f"file://{root}/").isEmpty()

    (root / "gone.txt").unlink()
    (root / "longer.txt").write_bytes(b"longer.txt!")
    (root / "other.txt").write_bytes(b"OTHER.txt")
    (root / "link.txt").unlink()
    (root / "link.txt").symlink_to(root / "sound.txt")
    (root / "stray.txt").write_bytes(b"stray")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "x.txt").write_bytes(b"x")
    (root / "folder").symlink_to(tmp_path / "outside")
    sha = hashlib.sha256(b"x").hexdigest()
    rows += [r for r in rows if r[0] == "twice.txt"] + [(p, 1, sha) for p in ("../outside/x.txt", "/etc/passwd", "C:\\x", "sub\\x", " ")] + [(None, 1, sha), ("bare.txt", None, sha), ("hash.txt", 1, "short"), ("empty.txt", 0, hashlib.sha256(b"").hexdigest()), ("sub/..x", 1, sha)]
    found = sorted((r.path or "", r.problem) for r in artifacts.verify(spark, spark.createDataFrame(rows, said.schema), str(root)).collect())
    expected = {
        "gone.txt": "MISSING", "longer.txt": "SIZE_MISMATCH", "other.txt": "HASH_MISMATCH", "twice.txt": "DUPLICATE_PATH", "link.txt": "SYMBOLIC_LINK", "stray.txt": "UNEXPECTED", "../outside/x.txt": "PATH_TRAVERSAL",
        "/etc/passwd": "PATH_TRAVERSAL", "C:\\x": "PATH_TRAVERSAL", "sub\\x": "PATH_TRAVERSAL", " ": "PATH_MISSING", "": "PATH_MISSING", "bare.txt": "MALFORMED_ENTRY", "hash.txt": "MALFORMED_ENTRY", "empty.txt": "EMPTY_ENTRY", "sub/..x": "MISSING",
    }
    # links to folders are followed by some file systems' listings and left out by others
    assert [x for x in found if not x[0].startswith("folder/")] == sorted(expected.items())
    assert all(p == "UNEXPECTED_LINK" for n, p in found if n.startswith("folder/"))

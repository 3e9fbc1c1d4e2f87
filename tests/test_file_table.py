"""Updates touch the files of changed rows and no other."""

from __future__ import annotations

from pathlib import Path

import pytest

from folioscope.operators import file_table


def contents(folder: Path) -> dict[str, tuple[bytes, int]]:
    return {str(p.relative_to(folder)): (p.read_bytes(), p.stat().st_mtime_ns) for p in folder.rglob("part-*")}


@pytest.fixture
def folder(session, tmp_path) -> str:
    rows = session.range(1000).selectExpr("cast(id as string) as id", "concat('r', id) as root", "if(id % 2 = 0, 'm', null) as meaning", "id as other").repartitionByRange(8, "other")
    file_table.create(rows, str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_only_touched_files_are_rewritten(session, folder) -> None:
    before, where = contents(Path(folder)), Path(folder)
    patches = session.createDataFrame([("3", "r3", "new"), ("4", "r4", None), ("5", "other root", "never"), ("6", "r6", "m")], "id string, root string, meaning string")
    assert file_table.update(session, folder, patches, ["id", "root"]) == 1
    after = contents(where)
    assert {k: after[k] for k in before} == before and len(after) == len(before) + 1
    assert sum(f in before for f in (x.removeprefix(folder + "/") for x in file_table.files(session, folder))) == len(before) - 1
    got = {r["id"]: r["meaning"] for r in file_table.read(session, folder).collect()}
    assert len(got) == 1000 and got["3"] == "new" and got["4"] == "m" and got["5"] is None and got["6"] == "m"
    assert file_table.update(session, folder, patches, ["id", "root"]) == 0 and contents(where) == after
    assert {r["id"]: r["meaning"] for r in file_table.read(session, folder, 0).collect()}["3"] is None


def test_nothing_matched_writes_nothing(session, folder) -> None:
    before = sorted(str(p) for p in Path(folder).rglob("*"))
    none = session.createDataFrame([("x", "y", "z"), (None, None, "z")], "id string, root string, meaning string")
    assert file_table.update(session, folder, none, ["id", "root"]) == 0 and sorted(str(p) for p in Path(folder).rglob("*")) == before


def test_the_second_of_two_updates_is_refused(session, folder) -> None:
    patches = session.createDataFrame([("3", "r3", "new")], "id string, root string, meaning string")
    file_table._publish(session, folder, [f.removeprefix(folder + "/") for f in file_table.files(session, folder)], 1)
    number, file_table._number = file_table._number, lambda *_: 0
    try:
        with pytest.raises(file_table.Outdated):
            file_table.update(session, folder, patches, ["id", "root"])
    finally:
        file_table._number = number
    assert file_table.read(session, folder).filter("meaning = 'new'").count() == 0

"""Rewritten files are handed back in large pieces."""

import pyarrow as pa

from veilscan.operators import remediate


def planned(rows):
    todo = pa.struct([("ord", pa.int32()), ("line", pa.int32()), ("env_var_name", pa.string()), ("value", pa.string())])
    fields = [("path", pa.string()), ("text", pa.string()), ("kind", pa.string()), ("import_at", pa.int32()), ("todo", pa.list_(todo))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def test_rewritten_files_are_handed_back_together(monkeypatch):
    rows = []
    for i in range(600):
        todo = [{"ord": 0, "line": 1, "env_var_name": "A", "value": f"v{i}x"}, {"ord": 1, "line": 2, "env_var_name": "B", "value": None}]
        rows.append({"path": f"p{i}", "text": None if i % 7 == 3 else f'k = "v{i}x"\n', "kind": "python", "import_at": 0, "todo": todo})
    whole, none = planned(rows), planned([])
    got = list(remediate._rewrite_batches(iter([whole.slice(0, 250), none, whole.slice(250)])))
    assert len(got) == 3
    back = pa.Table.from_batches(got).to_pylist()
    assert [r["path"] for r in back] == [r["path"] for r in rows] and [r["text_before"] for r in back] == [r["text"] for r in rows]
    assert back[0]["text_after"] == 'import os\nk = os.getenv("A")\n' and back[0]["import_at"] == 0
    assert back[0]["results"] == [
        {"ord": 0, "line": 1, "env_var_name": "A", "success": True, "error": None},
        {"ord": 1, "line": 2, "env_var_name": "B", "success": False, "error": remediate.NOT_EXTRACTED},
    ]
    assert back[0]["changes"] == [{"line": 1, "before": 'k = "v0x"', "after": 'k = os.getenv("A")'}, {"line": 1, "before": None, "after": "import os"}]
    assert back[3]["text_after"] is None and back[3]["results"][0]["error"] == remediate.NO_FILE
    assert list(remediate._rewrite_batches(iter([none]))) == []
    monkeypatch.setattr(remediate, "BATCH_CHARS", 1)  # long texts do not pile up
    assert len(list(remediate._rewrite_batches(iter([planned(rows[:2])])))) == 2

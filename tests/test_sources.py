"""File formats in and out, on small trees."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from gradeflow import jobs
from gradeflow.functions import rubric as rf
from gradeflow.operators import rubric
from gradeflow.sources import datasets, documents, runs, tasks
from gradeflow.sources.paths import below

SCHEMA = "q string, n bigint"


def test_json_lines_lists_and_members(spark, tmp_path):
    rows = [{"q": "é", "n": 1}, {"q": None, "n": 2}]
    (tmp_path / "a.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"note": "[not a list]", "z": rows, "a": [{"q": "later", "n": 3}]}))
    (tmp_path / "d.json").write_text(json.dumps({"note": 1}))
    wanted = [("é", 1), (None, 2)]

    def got(df):
        return [tuple(r) for r in df.orderBy("n").collect()]

    assert got(datasets.read_json_lines(spark, f"{tmp_path}/a.jsonl", SCHEMA)) == wanted
    assert got(datasets.read_json_list(spark, f"{tmp_path}/b.json", SCHEMA)) == wanted
    assert got(datasets.read_json_member(spark, f"{tmp_path}/c.json", SCHEMA)) == wanted
    assert got(datasets.read_json_member(spark, f"{tmp_path}/c.json", SCHEMA, "a")) == [("later", 3)]
    with pytest.raises(Exception, match="no list in the JSON document"):
        datasets.read_json_member(spark, f"{tmp_path}/d.json", SCHEMA).collect()
    with pytest.raises(Exception, match="no list in the JSON document"):
        datasets.read_json_member(spark, f"{tmp_path}/d.json", SCHEMA, "a").collect()
    both = datasets.read_splits(spark, f"{tmp_path}/a.jsonl", None, datasets.read_json_lines, schema=SCHEMA)
    assert {r["split"]: r["n"] for r in both.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 2, "test": 2}


def word_file(paragraphs) -> bytes:
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    return zipped({"word/document.xml": f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>'})


def sheet_file(sheets) -> bytes:
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = "".join(f'<sheet name="S{i}" sheetId="{i}" r:id="rId{i}"/>' for i in range(len(sheets)))
    links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets)))
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>",
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>shared</t></si></sst>',
    }
    for i, rows in enumerate(sheets):
        files[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>'
    return zipped(files)


def zipped(files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, body in files.items():
            archive.writestr(name, body)
    return out.getvalue()


ROWS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c><c r="N1"><v>9</v></c></row>'
    '<row r="2"/><row r="3"><c r="B3" t="b"><v>1</v></c><c r="D3" t="inlineStr"><is><t>in</t></is></c></row>'
    '<row r="41"><c r="A41"><v>far</v></c></row>'
)
MAIL = b"Subject: s\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>h</p>\n--B\nContent-Type: text/plain\n\nplain body\n--B--\n"
RUNS = [
    "<w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r>",
    "<w:r><w:t> </w:t></w:r>",
    '<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:br/><w:t>next</w:t><w:br w:type="page"/></w:r>',
]
CONTENTS = {
    "a.TXT": b" text\xff ",
    "sub/b.json": b'{"k": 1}',
    "m.eml": MAIL,
    "w.docx": word_file(RUNS),
    "x.xlsx": sheet_file([ROWS] * 5),
    "broken.docx": b"no archive",
    "pic.PNG": b"\x89",
    "noext": b"x",
}
EXTRACTED = {
    "a.TXT": "text�",
    "sub/b.json": '{"k": 1}',
    "m.eml": "plain body",
    "w.docx": "one\ttwo\nlink\nnext",
    "broken.docx": "(error reading broken.docx: File is not a zip file)",
    "pic.PNG": "(document available but not extracted: pic.PNG)",
    "noext": "(document available but not extracted: noext)",
}
SHEET_LINES = ["shared\t\t2.5" + "\t" * 9, "\tTrue\t\tin" + "\t" * 8]


@pytest.fixture
def tree(tmp_path):
    tmp_path = tmp_path / "tasks" / "a b" / "documents"
    for area, name, count in (("tax", "t1", 2), ("tax", "t2", 0), ("ip", "deep/t3", 1), ("ip", "t+4 x", 1)):
        folder = tmp_path / "tasks" / area / name
        folder.mkdir(parents=True)
        criteria = [{"id": f"C{i}", "title": f"Title {i}", "match_criteria": f"Must {i}", "deliverables": ["b.md", "a.md"]} for i in range(count)]
        body = {"title": f"T {name}", "instructions": None, "deliverables": {"x": "z.md", "y": "c.md"}, "criteria": criteria}
        (folder / "task.json").write_text(json.dumps(body))
    odd = tmp_path / "tasks" / "ip" / "t+4 x" / "documents"
    odd.mkdir()
    (odd / "n+1 é%20.txt").write_text("odd name")
    for name, content in CONTENTS.items():
        path = tmp_path / "tasks" / "tax" / "t1" / "documents" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path


def test_tasks(spark, tree):
    found = {r["task_id"]: r for r in tasks.read_tasks(spark, str(tree)).collect()}
    assert set(found) == {"tax/t1", "tax/t2", "ip/deep/t3", "ip/t+4 x"}
    assert found["tax/t1"]["deliverables"] == ["a.md", "b.md"] and found["tax/t2"]["deliverables"] == ["c.md", "z.md"]
    assert found["ip/deep/t3"]["practice_area"] == "ip" and found["tax/t1"]["instructions"] == ""
    assert [c["id"] for c in found["tax/t1"]["criteria"]] == ["C0", "C1"]


def test_document_formats(spark, tree):
    read = documents.read_document_files(spark, str(tree), 1200)
    rows = read.collect()
    assert [(r["path"], r["text"]) for r in rows if r["task_id"] == "ip/t+4 x"] == [("n+1 é%20.txt", "odd name")]
    got = {r["path"]: r["text"] for r in rows if r["task_id"] == "tax/t1"}
    assert len(rows) == len(CONTENTS) + 1
    sheet = got.pop("x.xlsx")
    assert got == EXTRACTED
    wanted = "\n".join(line for i in range(4) for line in (f"=== Sheet: S{i} ===", *SHEET_LINES))
    assert sheet == wanted.strip()
    only = documents.read_document_files(spark, str(tree), 1200, spark.createDataFrame([("ip/t",)], "task_id string"))
    assert only.count() == 0


def test_document_counts(spark, tree):
    rows = rubric.document_counts(documents.list_document_files(spark, str(tree))).collect()
    assert {tuple(r) for r in rows} == {("tax/t1", len(CONTENTS), len(CONTENTS)), ("ip/t+4 x", 1, 1)}


def test_default_deliverable(spark):
    raw = spark.createDataFrame(
        [("a/b", None, None, None, None, None)],
        f"task_id string, title string, work_type string, instructions string, deliverables map<string,string>, criteria {rf.CRITERIA_TYPE}",
    )
    row = tasks.shape_tasks(raw).first()
    assert row["deliverables"] == ["output.md"] and row["criteria"] == []


@pytest.mark.parametrize("generated", [False, True])
def test_rubric_set_end_to_end(spark, tree, tmp_path, generated):
    out = str(tmp_path / "out")
    judged = {"summary": "S", "score": 0.5, "all_pass": False,
              "criteria_results": [{"id": "C1", "title": "t", "verdict": "fail", "reasoning": "r"}]}
    (tree / "scores" / "tax" / "t1").mkdir(parents=True)
    (tree / "scores" / "tax" / "t1" / "scores.json").write_text(json.dumps(judged))
    scores = tasks.read_scores(spark, str(tree))

    def echo(batches):
        for batch in batches:
            yield batch[["task_id"]].assign(attempt=" draft for " + batch["task_id"] + "\n")

    made = jobs.build_rubric_set(
        spark, str(tree), out, created_at=F.lit("2024-01-02 03:04:05").cast("timestamp"), model="m",
        train_tasks=3, preview_tasks=1, generate=echo if generated else None, scores=scores,
    ).collect()
    records = datasets.read_records(spark, f"{out}/records").collect()
    train = [r for r in records if r["split"] == "train"]
    test = [r for r in records if r["split"] == "test"]
    assert (len(train), len(test), len(made)) == (3, 1, 4)
    assert all(r["extra_info"]["feedback_raw"] == r["extra_info"]["previous_attempt"] == "" for r in test)
    assert test[0]["prompt"][0]["content"] == test[0]["extra_info"]["original_prompt"]
    for r in train:
        assert "Harvey LAB rubric feedback:" in r["prompt"][0]["content"]
        attempt = r["extra_info"]["previous_attempt"]
        assert attempt.startswith("draft for" if generated else "# Draft work product for T ")
    by_task = {r["extra_info"]["task_id"]: r["extra_info"] for r in records}
    if by_task["tax/t1"]["split"] == "train":
        assert "Required standard: Must 1" in by_task["tax/t1"]["feedback_raw"]
    assert json.loads(by_task["tax/t1"]["harvey_scores_json"]) == judged
    assert list(json.loads(by_task["tax/t1"]["harvey_scores_json"])) == sorted(judged)
    assert "\n### m.eml\nplain body" in by_task["tax/t1"]["original_prompt"]
    body = json.loads(spark.read.text(f"{out}/manifest").first()[0])
    assert body["heldout_eval_count"] == spark.read.parquet(f"{out}/heldout").count() == 1
    assert {r["run_id"] for r in body["runs"]} == {r["run_id"] for r in made}
    assert made[0]["run_id"].endswith("/qwen36_35b_a3b/20240102T030405Z")


def test_question_and_conversation_sets(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(12)], "id int, question string, answer string")
    out = str(tmp_path / "qa")
    counts = {r["split"]: r["rows"] for r in jobs.build_question_set(rows, None, out, order=["id"], rows={"train": 8, "test": 4}, data_source="d").collect()}
    assert counts == {"train": 8, "test": 4}
    whole = jobs.build_question_set(rows, None, out + "0", order=["id"], data_source="d").collect()
    assert {r["split"]: r["rows"] for r in whole} == {"train": 12, "test": 12}
    test = datasets.read_records(spark, out, "test").select("extra_info.index", "extra_info.answer").collect()
    assert {tuple(r) for r in test} == {(i, f"a{i}") for i in range(4)}
    every = jobs.build_distillation_set(rows, rows.limit(3), out + "2", order=["id"], rows={"train": 0, "test": 2}, data_source="d")
    assert {r["split"]: r["rows"] for r in every.collect()} == {"train": 12, "test": 2}
    talk = spark.createDataFrame([(i, f'{{"c":[{{"from":"human","value":"h{i}"}}]}}') for i in range(3)], "id int, j string")
    talk = talk.select("id", F.from_json("j", "c variant")["c"].alias("conversations"))
    jobs.build_conversation_set(talk, None, out + "3", order=["id"], data_source="d")
    first = datasets.read_records(spark, out + "3", "train").where("extra_info.index = 1").first()
    assert first["extra_info"]["feedback_raw"] == "Successful reference trajectory:\nhuman: h1"


def test_run_store(spark, tmp_path):
    run = {
        "id": "r1", "name": "n", "status": "draft", "created_at": "2024-01-01T00:00:00+00:00", "config": {"model": "m", "steps": 4, "seed": 7},
        "metrics": [{"step": 1, "reward": 0.5}], "logs": ["a", "b"],
        "traces": [{"id": "t", "reward": 1.0, "tokens": [{"text": "x", "delta": 0.3, "selected": True}]}],
    }
    (tmp_path / "runs.json").write_text(json.dumps({"runs": [run, {**run, "id": "r2", "logs": []}]}))
    found = runs.read_run_store(spark, f"{tmp_path}/runs.json")
    assert [r["config"]["steps"] for r in found.collect()] == [4, 4]
    assert {tuple(r) for r in runs.run_logs(found).collect()} == {("r1", 0, "a"), ("r1", 1, "b")}
    assert runs.run_metrics(found).where("run_id = 'r2'").first()["reward"] == 0.5
    assert runs.run_traces(found).first()["tokens"][0]["delta"] == 0.3
    assert json.loads(found.select(F.to_json("whole")).first()[0]) == run


@pytest.mark.parametrize("root, path, inside", [
    ("/a/b", "file:/a/b/tasks/x", True),
    ("/a/b/", "/a/b/tasks/x", True),
    ("s3a://bucket/a", "s3a://bucket/a/tasks/x", True),
    ("data/set", "hdfs://host:1/user/me/data/set/tasks/x", True),
    ("./data", "file:/w/data/tasks/x", True),
    ("/b", "file:/a/b/tasks/x", False),
])
def test_paths_below_a_root(root, path, inside):
    pattern = below(root, "/tasks/(.+)$").replace("\\Q", "").replace("\\E", "")
    assert bool(re.search(pattern, path)) == inside


SCORED = [
    (None, "- A t: m\n- B : ", "{}"),
    ("{}", "- A t: m\n- B : ", "{}"),
    ('{"score": 1}', "Harvey LAB rubric feedback", '{"score":1}'),
    ('{"weight": 2, "judge_model": "j"}', "Harvey LAB rubric feedback", '{"judge_model":"j","weight":2}'),
    (
        '{"score": 0.0, "note": null, "criteria_results": [{"weight": 0.5, "verdict": "pass", "id": "A", "seen": {"b": [1], "a": true}}]}',
        "Harvey LAB rubric feedback\n- PASS A: \n  Judge reasoning:",
        '{"criteria_results":[{"id":"A","seen":{"a":true,"b":[1]},"verdict":"pass","weight":0.5}],"note":null,"score":0.0}',
    ),
    (
        '{"summary": "S", "criteria_results": [{"id": "A", "verdict": "Fail"}, {"id": "Z"}, {"id": "B"}, {"verdict": "ok", "title": "T"}]}',
        "S\n- FAIL A: \n  Judge reasoning: \n  Required standard: m\n- FAIL Z: \n  Judge reasoning: \n- FAIL B: \n"
        "  Judge reasoning: \n- OK : T\n  Judge reasoning:",
        '{"criteria_results":[{"id":"A","verdict":"Fail"},{"id":"Z"},{"id":"B"},{"title":"T","verdict":"ok"}],"summary":"S"}',
    ),
]


def test_feedback_of_every_kind_of_scores(spark):
    criteria = [("A", "t", "m", []), ("B", None, None, []), ("A", "t2", "m2", [])]
    rows = [(str(i), criteria[: 2 if i < 2 else 3], text) for i, (text, _, _) in enumerate(SCORED)]
    made = spark.createDataFrame(rows, f"task_id string, criteria {rf.CRITERIA_TYPE}, value string")
    judged = rubric.with_scores(made.drop("value"), tasks.parse_scores(made))
    got = judged.select("feedback", rf.scores_json(F.col("scores")).alias("j")).orderBy("task_id").collect()
    assert [(r["feedback"], r["j"]) for r in got] == [(text.strip(), j) for _, text, j in SCORED]


def test_missing_attempts_get_the_fallback(spark):
    made = spark.createDataFrame(
        [("a", "T", [(f"C{i}", f"t{i}", "", []) for i in range(14)]), ("b", "T", [])], f"task_id string, title string, criteria {rf.CRITERIA_TYPE}"
    )
    attempts = spark.createDataFrame([("b", "mine")], "task_id string, attempt string")
    got = {r["task_id"]: r["attempt"] for r in rubric.with_attempts(made, attempts).collect()}
    assert got["b"] == "mine" and got["a"].count("- TODO ") == 12 and got["a"].endswith("- TODO C11: t11\n")


@pytest.mark.parametrize("limit", [250, 330, 900])
def test_documents_cut_before_gathering_leave_the_prompt_as_it_is(spark, limit):
    """The prompt of all documents, made by hand, against the prompt of those that can reach it."""
    docs = [("t", f"d{i % 3}-x/{i}" if i % 2 else f"d{i % 3}/{i}", ["", "\n\n\n", "text\n\n\n\nmore"][i % 3]) for i in range(400)]
    task = [("t", "T", "w", "do", ["out.md"], [])]
    made = spark.createDataFrame(
        task, f"task_id string, title string, work_type string, instructions string, deliverables array<string>, criteria {rf.CRITERIA_TYPE}"
    )
    documents_of = spark.createDataFrame(docs, "task_id string, path string, text string").repartition(6)
    got = rubric.with_prompt(made, documents_of, prompt_chars=limit).first()["prompt"]
    blocks = [f"\n### {path}\n{body}" for _, path, body in sorted(docs, key=lambda d: d[1].split("/"))]
    head = [rf.PROMPT_OPENING, "Task ID: t", "Title: T", "Work type: w", "Instructions: do", rf.DELIVERABLES_HEADING,
            "- out.md", rf.DOCUMENTS_HEADING]
    whole = re.sub("\n{3,}", "\n\n", "\n\n".join([*head, *blocks, rf.PROMPT_CLOSING]).strip())
    cut = got.removesuffix("\n[truncated]")
    assert cut != got and whole.startswith(cut + "\n") and len(cut) <= limit
    assert "\n" not in whole[len(cut) + 1 : limit]

"""Jobs and their HTTP face."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from chunkloom.operators import stages
from chunkloom.progress import Told
from chunkloom.service import Jobs, options, server
from chunkloom.sources.files import from_text

MD = "# Guide\n\nSome words stand here. They explain things well enough for anybody who reads.\n\n## Tags\n\na1; b2; c3; d4; e5\n"


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    s = server(spark, str(tmp_path_factory.mktemp("jobs")), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def ask(url, data=None, method=None, headers=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers or {}, method=method)) as r:
            body = r.read()
            return r.status, json.loads(body) if "json" in r.headers["Content-Type"] and "nd" not in r.headers["Content-Type"] else body.decode()
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_requests(base):
    assert ask(f"{base}/health")[1]["jobs"] == 0 and ".md" in ask(f"{base}/formats")[1]["input_formats"]
    status, job = ask(f"{base}/process/text", json.dumps({"text": MD, "title": "T", "options": {"strategy": "semantic", "min_size": 5}}).encode())
    assert status == 200 and job["status"] == "completed"
    at = f"{base}/jobs/{job['job_id']}"
    form = b"--x\r\nContent-Disposition: form-data; name=\"file\"; filename=\"data.csv\"\r\n\r\nname,role\nAnn,x\nBob,y\n\r\n--x\r\nContent-Disposition: form-data; name=\"strategy\"\r\n\r\nsentence\r\n--x--\r\n"
    status, second = ask(f"{base}/process", form, headers={"Content-Type": "multipart/form-data; boundary=x"})
    assert status == 200 and second["title"] == "Data"
    assert [j["job_id"] for j in ask(f"{base}/jobs")[1]] == [second["job_id"], job["job_id"]]
    page = ask(f"{at}/chunks?search=EXPLAIN&knowledge_only=true")[1]
    assert page["total"] == 1 and page["chunks"][0]["retrieval"]["tags"] == ["Tags", "a1", "b2", "c3", "d4", "e5"]
    assert ask(f"{at}/chunks?search=nowhere")[1]["total"] == 0 and ask(f"{at}/chunks?offset=9")[1]["chunks"] == []
    assert ask(f"{at}/statistics")[1]["sizes"]["n"] == 1 and ask(f"{at}/validate")[1]["ok"]
    document = ask(f"{at}/preview")[1]["documents"][0]
    assert document["spans"][0]["chunk_id"] == page["chunks"][0]["id"] and document["content"][document["spans"][0]["start"] :].startswith("# Guide")
    assert json.loads(ask(f"{at}/export?format=jsonl")[1])["id"] == page["chunks"][0]["id"]
    assert ask(f"{at}/export?format=odd")[0] == 400 and ask(f"{base}/process/text", b"{}")[0] == 400 and ask(f"{base}/nothing")[0] == 404
    assert ask(f"{base}/process?filename=x.bin", b"\0")[0] == 400 and ask(f"{base}/process/text", json.dumps({"text": "x", "options": {"unit": "miles"}}).encode())[0] == 400
    assert ask(at, method="DELETE")[1]["status"] == "deleted" and ask(at)[0] == 404 and ask(at, method="DELETE")[0] == 404
    assert len(ask(f"{base}/jobs")[1]) == 1


def test_a_failed_job_is_listed(spark, tmp_path):
    jobs = Jobs(spark, str(tmp_path))
    with pytest.raises(Exception):
        jobs.process(spark.createDataFrame([(1,)], "other int"), options({}), "t", "s")
    assert [j.status for j in jobs.list().collect()] == ["failed"]


def test_progress(spark):
    told = []
    stages.run(from_text(spark, MD), progress=Told(lambda *x: told.append(x)))
    assert [x[:2] for x in told] == [(0, 2), (1, 2), (2, 2), (2, 2)]

"""Prompts to a model server on this machine: eight at a time, with errors that stay with their rows."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quern.config import NO_ANSWER
from quern.operators import answering, generation


class Model:
    """Repeats a prompt's first line; some lines make it fail, hang, or answer nonsense."""

    def __init__(self):
        self.now = self.most = self.connections = 0
        self.asked = {}
        self.lock = threading.Lock()
        model = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def setup(self):
                with model.lock:
                    model.connections += 1
                super().setup()

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                prompt = body["messages"][1]["content"]
                assert self.path == "/base/api/chat" and body["messages"][0]["content"] == answering.SYSTEM and body["options"] == {"temperature": 0.0, "seed": 0}
                with model.lock:
                    model.now += 1
                    model.most = max(model.most, model.now)
                    model.asked[prompt] = model.asked.get(prompt, 0) + 1
                time.sleep(3 if prompt == "hang" else 0.05)
                with model.lock:
                    model.now -= 1
                status, said = 200, {"message": {"content": [{"text": " " + prompt.partition("\n")[0]}, "! "]}}
                if prompt == "fail" or prompt == "once" and model.asked[prompt] == 1:
                    status, said = 503, {"error": "busy"}
                elif prompt == "model":
                    status, said = 404, {"error": "model 'm' not found"}
                elif prompt == "odd":
                    said = {"nothing": 1}
                out = json.dumps(said).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)

            def log_message(self, *args):
                pass

        class Server(ThreadingHTTPServer):
            request_queue_size = 64

            def handle_error(self, *args):
                pass

        self.server = Server(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/base/"


@pytest.fixture
def model():
    made = Model()
    yield made
    made.server.shutdown()
    made.server.server_close()


def told(spark, model, prompts, timeout=30.0, **pool):
    rows = spark.createDataFrame(list(enumerate(prompts)), "k long, prompt string").coalesce(1)
    got = rows.select("k", generation.generate(F.col("prompt"), generation.ChatServer, model.url, "m", timeout, **pool).alias("g")).collect()
    return [(r["g"]["said"], r["g"]["error"]) for r in sorted(got)]


def test_a_hundred_prompts_eight_at_a_time(spark, model):
    prompts = [f"prompt {k}" for k in range(100)]
    prompts[17], prompts[40], prompts[41] = "fail", None, "model"
    got = told(spark, model, prompts, pause=0.01)
    assert model.most == 8 and model.connections <= 8
    for k, (said, error) in enumerate(got):
        if k == 17:
            assert said is None and "answered 503" in error and model.asked["fail"] == 3
        elif k == 40:
            assert said is None and error is None
        elif k == 41:
            assert said is None and "not found" in error and model.asked["model"] == 1
        else:
            assert (said, error) == (f"prompt {k}!", None)


def test_tries_timeouts_and_nonsense(spark, model):
    got = told(spark, model, ["once", "hang", "odd", "fine"], 0.5, attempts=2, pause=0.01)
    assert [g[0] for g in got] == ["once!", None, None, "fine!"]
    assert got[1][1].startswith("ConnectionError") and "timed out" in got[1][1] and got[2][1].startswith("Refused")
    assert model.asked["once"] == 2 and model.asked["odd"] == 1


def test_answers_with_the_classes_of_their_errors(spark, model):
    hits = [(q, 1, q != 4, 0.1, "b", f"c{q}", "", "u", f"text {q}") for q in range(5)]
    hits = spark.createDataFrame(hits, "query_id long, rank long, passes_threshold boolean, score double, book string, chapter string, section string, source_url string, text string")
    questions = spark.createDataFrame([(q, f"question {q}") for q in range(6)], "query_id long, question string")
    class_of = {r["query_id"]: r for r in generation.answers(questions, hits, 3, generation.ChatServer, model.url, "m", 30.0).collect()}
    assert [class_of[q]["found"] for q in range(6)] == [True] * 4 + [False] * 2
    assert class_of[1]["answer"] == answering.INTRO + "!" and class_of[1]["sources"][0]["chapter"] == "c1" and class_of[1]["error"] is None
    assert class_of[4]["answer"] == class_of[5]["answer"] == NO_ANSWER and class_of[4]["error"] is None
    lost = generation.answers(questions, hits, 3, generation.ChatServer, "http://127.0.0.1:1", "m", 1.0, attempts=1).collect()
    assert {r["query_id"]: r["error"] for r in lost} == {0: "server_down", 1: "server_down", 2: "server_down", 3: "server_down", 4: None, 5: None}
    assert all(r["answer"] == NO_ANSWER and not r["found"] and r["sources"] == [] for r in lost)


def test_pooled_answers_are_the_plain_ones(spark):
    hits = spark.createDataFrame([(0, 1, True, 0.1, "b", "c", "", "u", "one two three")], "query_id long, rank long, passes_threshold boolean, score double, book string, chapter string, section string, source_url string, text string")
    questions = spark.createDataFrame([(0, "q"), (1, "r")], "query_id long, question string")
    plain = answering.answers(questions, hits)
    assert sorted(generation.answers(questions, hits, 3, answering.Extractive).drop("error").collect()) == sorted(plain.collect())

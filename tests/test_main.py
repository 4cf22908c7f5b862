import json

import pytest

from folioscope.__main__ import main
from folioscope.session import fresh_folder


def test_commands(spark, tmp_path):
    (tmp_path / "owls.txt").write_text("owls hunt at night\nand sleep by day")
    (tmp_path / "fish.txt").write_text("trout swim upstream")
    (tmp_path / "other.pdf").write_text("not read as text")
    qa = tmp_path / "qa.json"
    qa.write_text(json.dumps([{"question": "when do owls hunt", "ground_truth": "owls hunt at night\nand sleep by day [1]"}]))
    config = tmp_path / "config.yaml"
    config.write_text("collection: 'birds'\n")
    index = fresh_folder(spark, "test-main")
    common = ["--config", str(config), "--vector-size", "32"]

    assert "'birds' not found" in main([*common, "info", index], {})
    with pytest.raises(ValueError, match="does not exist"):
        main([*common, "ask", index, "anything"], {})
    added = main([*common, "ingest", index, str(tmp_path), "--text"], {}).collect()
    assert sorted(r["file_name"] for r in added) == ["fish.txt", "owls.txt"]
    assert main([*common, "info", index], {}).first()["points_count"] == 2
    assert "'elsewhere' not found" in main([*common, "info", index], {"COLLECTION_NAME": "elsewhere"})
    answers = main([*common, "ask", index, "when do owls hunt", "how do trout swim"], {}).collect()
    assert sorted(r["answer"] for r in answers) == ["owls hunt at night\nand sleep by day [1]", "trout swim upstream [1]"]
    assert answers[0]["references"].count("\n") == 1
    scores = {r["metric"]: float(r["mean"]) for r in main([*common, "evaluate", index, str(qa)], {}).collect()}
    assert set(scores) == {"faithfulness", "answer_relevancy", "answer_correctness"}
    assert scores["faithfulness"] == 1.0
    assert scores["answer_correctness"] == pytest.approx(1.0, abs=1e-3)

    judged = main([*common, "judge", index, str(qa)], {}).collect()
    assert [(r["score"], r["success"], r["mean_score"]) for r in judged] == [(0.5, True, 0.5)]
    assert judged[0]["statements"] == ["owls hunt at night", "and sleep by day [1]"]

    chat = tmp_path / "chat.json"
    rows = [("s", 0, "user", "hello"), ("s", 1, "assistant", "hi"), ("s", 2, "user", "how do trout swim"), ("t", 0, "assistant", "x")]
    chat.write_text("\n".join(json.dumps(dict(zip(("session_id", "turn", "role", "text"), r))) for r in rows))
    replies = main([*common, "chat", index, str(chat)], {}).collect()
    assert [tuple(r) for r in replies] == [("s", 3, "assistant", "trout swim upstream [1]")]


def test_half_a_chat_service_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="CHAT_API_URL, CHAT_API_KEY"):
        main(["ask", str(tmp_path), "x"], {"CHAT_API_URL": "http://host"})

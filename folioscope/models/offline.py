"""An offline judge: a stand-in for a hosted one, with no claim to its quality."""

from __future__ import annotations

import json

from folioscope.models.hashing import _WORD


class LineJudge:
    """Takes an answer's lines as its statements, and a statement that shares a word with the question
    as relevant.  Reads the JSON object on the last line of a prompt."""

    def complete(self, prompt: str) -> str:
        asked = json.loads(prompt.rsplit("\n", 1)[-1])
        if "statement" not in asked:
            lines = (line.strip() for line in asked.get("answer", "").split("\n"))
            return json.dumps({"statements": [line for line in lines if line]})
        common = set(_WORD.findall(asked["question"].lower())) & set(_WORD.findall(asked["statement"].lower()))
        return json.dumps({"verdicts": ["yes" if common else "no"]})

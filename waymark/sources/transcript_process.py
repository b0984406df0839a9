"""A process that keeps a transcript: what it says of a turn depends on all turns since the last reset. It stands for an environment behind pipes where none is installed.

Messages: reset starts an episode, step adds a text, close ends. Answers tell the number of turns, their characters and the MD5 of the text before.
"""

from __future__ import annotations

import hashlib
import json
import sys


def main() -> None:
    turns, characters, before = 0, 0, None
    for line in sys.stdin:
        message = json.loads(line)
        command = message.get("command")
        answer = {"ok": True}
        if command == "close":
            return
        if command == "reset":
            turns, characters, before = 0, 0, None
        elif command == "step":
            text = message["text"]
            turns, characters = turns + 1, characters + len(text)
            answer |= {"turns": turns, "characters": characters, "before": before}
            before = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
        else:
            answer = {"ok": False, "error": f"unknown command {command}"}
        sys.stdout.write(json.dumps(answer) + "\n")
        sys.stdout.flush()


if __name__ == "__main__":
    main()

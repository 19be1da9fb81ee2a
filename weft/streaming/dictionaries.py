"""Session dictionaries over a stream of signed proposals: authentication, replay protection, epochs and answers.

A proposal names its session, a nonce, the epoch it makes, the state it starts from and the one it ends with, and
the templates it adds.  Its identity is the hash of that body; its tag signs it.  Every proposal is answered once,
and the answer is signed too, so that a sender uses new templates only after it has verified the answer.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_ADDITIONS, MOST_TEMPLATES, MOST_BYTES, REMEMBERED = 64, 1024, 1024, 4096
ANSWERS = "session string, diff_id string, accepted boolean, reason string, epoch long, state_hash string, tag string"


def _json(x: object) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _sign(text: str, key: bytes) -> str:
    return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def state_hash(templates: dict[int, str], epoch: int) -> str:
    return hashlib.sha256(_json({"epoch": epoch, "templates": sorted(templates.items())}).encode()).hexdigest()


def propose(session: str, templates: dict[int, str], additions: dict[int, str], epoch: int, nonce: str, key: bytes) -> tuple[str, str]:
    """Body and tag of a proposal that adds to templates as they are at epoch."""
    after = templates | additions
    body = _json({"session": session, "nonce": nonce, "epoch": epoch + 1, "additions": sorted(additions.items()), "before": state_hash(templates, epoch), "after": state_hash(after, epoch + 1), "count": len(after)})
    return body, _sign(body, key)


def verdict(body: str, tag: str, session: str, templates: dict[int, str], epoch: int, seen: set[str], key: bytes) -> tuple[str | None, dict]:
    """Why a proposal is refused (None if it is not), and what it says; the first rule that fails counts."""
    if not hmac.compare_digest(_sign(body or "", key), tag or ""):
        return "not authentic", {}
    try:
        said = json.loads(body)
        added = {int(k): str(v) for k, v in said["additions"]}
        nonce, makes = str(said["nonce"]), int(said["epoch"])
    except (ValueError, KeyError, TypeError):
        return "malformed", {}
    rules = [
        (said.get("session") != session, "session mismatch"),
        (nonce in seen or hashlib.sha256(body.encode()).hexdigest() in seen, "replay"),
        (said.get("before") != state_hash(templates, epoch), "previous state mismatch"),
        (makes != epoch + 1, "epoch must increment by one"),
        (not added, "no additions"),
        (len(added) > MOST_ADDITIONS, "too many additions"),
        (any(templates.get(k) == v for k, v in added.items()), "template repeated"),
        (any(k in templates for k in added), "template overwritten"),
        (len(templates) + len(added) > MOST_TEMPLATES or any(len(v.encode()) > MOST_BYTES for v in added.values()), "out of bounds"),
        (said.get("count") != len(templates | added), "count mismatch"),
        (said.get("after") != state_hash(templates | added, epoch + 1), "next state mismatch"),
    ]
    return next((why for fails, why in rules if fails), None), {"added": added, "nonce": nonce}


def answer_verified(answer: dict, body: str, key: bytes) -> bool:
    """Whether an answer is authentic, accepts this very proposal and ends in the state that it names."""
    unsigned = {k: answer[k] for k in ("session", "diff_id", "accepted", "reason", "epoch", "state_hash")}
    said = json.loads(body)
    return hmac.compare_digest(_sign(_json(unsigned), key), answer["tag"]) and bool(answer["accepted"]) and answer["diff_id"] == hashlib.sha256(body.encode()).hexdigest() and answer["epoch"] == said["epoch"] and answer["state_hash"] == said["after"]


def apply_proposals(stream: DataFrame, key: bytes) -> DataFrame:
    """ANSWERS to rows (session, seq, body, tag), in the order of seq within a batch.

    The state of a session holds its templates, its epoch and the last REMEMBERED nonces and identities, which the
    bounds above keep small.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"epoch": 0, "templates": [], "seen": []}
        templates, epoch, seen, out = {int(k): v for k, v in held["templates"]}, held["epoch"], list(held["seen"]), []
        rows = pd.concat(list(frames)).sort_values("seq")
        for body, tag in zip(rows["body"], rows["tag"], strict=True):
            why, said = verdict(body, tag, group[0], templates, epoch, set(seen), key)
            diff_id = hashlib.sha256((body or "").encode()).hexdigest()
            if why is None:
                templates, epoch, seen = templates | said["added"], epoch + 1, [*seen, said["nonce"], diff_id][-REMEMBERED:]
            answer = {"session": group[0], "diff_id": diff_id, "accepted": why is None, "reason": why, "epoch": epoch, "state_hash": state_hash(templates, epoch)}
            out.append([*answer.values(), _sign(_json(answer), key)])
        state.update((_json({"epoch": epoch, "templates": sorted(templates.items()), "seen": seen}),))
        yield pd.DataFrame(out, columns=["session", "diff_id", "accepted", "reason", "epoch", "state_hash", "tag"])

    return stream.groupBy("session").applyInPandasWithState(run, ANSWERS, "held string", "append", GroupStateTimeout.NoTimeout)

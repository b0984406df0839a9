"""The laboratory as a table of skills over a flat state.

A state is a dict: minute; samples (id to sites, protocol, priority, stage, place, measured, saved, verified); prep (sample, status); agv
(place, load); slots A and B; robot (zone, held, slot, side); background (captured minute or None); instrument (protocol,
configured, run, site, result). A skill is a row of KINDS: guards that name what is wrong, and an effect on a copy of the state.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass

# Places, minutes and costs of the skills, the validity of a background capture.
PLACES = {"shelf": "SHELF", "prep": "PREP", "ir": "IR", "standby": "STANDBY"}
FRONT, BACK = "POINTS_1_3", "POINTS_4_6"
BACKGROUND_MINUTES = 120
HOLDER_OF = {"SHELF_RAW": "shelf", "SHELF_FINISHED": "finished", "PREP": "prep", "AGV": "agv", "TRANSFER_A": "A", "TRANSFER_B": "B", "ROBOT": "robot"}
State = dict
Guard = Iterator[str]


@dataclass(frozen=True)
class Skill:
    name: str
    domain: str
    cost: float
    minutes: int
    guards: Callable[[State, str], Guard]
    effect: Callable[[State, str], None]
    parameter: str = ""


def new_state(samples: dict, minute: int = 0, **parts) -> State:
    base = {
        "minute": minute, "samples": samples, "prep": {"sample": None, "status": "EMPTY"}, "agv": {"place": "STANDBY", "load": None}, "slots": {"A": None, "B": None},
        "robot": {"zone": "WAIT_LOADING", "held": None, "slot": None, "side": None}, "background": None,
        "instrument": {"protocol": None, "configured": None, "run": "IDLE", "site": None, "result": None},
    }
    for key, value in parts.items():
        base[key] = base[key] | value if isinstance(base[key], dict) and isinstance(value, dict) else value
    return base


def sample(sites, protocol: str, priority: int, **parts) -> dict:
    return {"sites": sorted(set(sites)), "protocol": protocol, "priority": priority, "stage": "RAW", "place": "SHELF_RAW", "measured": [], "saved": False, "verified": False} | parts


def held(s: State) -> dict | None:
    return s["samples"].get(s["robot"]["held"])


def carried(s: State) -> dict | None:
    return s["samples"].get(s["agv"]["load"])


def background_valid(s: State) -> bool:
    return s["background"] is not None and s["minute"] - s["background"] <= BACKGROUND_MINUTES


def broken(s: State) -> list[str]:
    """Violated invariants: every sample has one holder, the one that its place says; stations and robot agree with what they hold."""
    out = []
    holders = {i: [HOLDER_OF[x["place"]]] if x["place"].startswith("SHELF") else [] for i, x in s["samples"].items()}
    for where, i in (("prep", s["prep"]["sample"]), ("agv", s["agv"]["load"]), *s["slots"].items(), ("robot", s["robot"]["held"])):
        if i:
            holders.setdefault(i, []).append(where)
    for i, x in s["samples"].items():
        if len(holders[i]) > 1:
            out.append(f"{i}: several holders")
        if HOLDER_OF[x["place"]] not in holders[i]:
            out.append(f"{i}: not where it should be")
        if x["stage"] == "RAW" and x["verified"]:
            out.append(f"{i}: raw but verified")
        if x["place"] == "SHELF_FINISHED" and x["stage"] != "CHARACTERIZED":
            out.append(f"{i}: finished but not characterized")
    if set(holders) - set(s["samples"]):
        out.append("unknown sample held")
    if (s["prep"]["status"] == "EMPTY") != (s["prep"]["sample"] is None):
        out.append("preparation status and sample differ")
    if not s["robot"]["held"] and (s["robot"]["slot"] or s["robot"]["side"]):
        out.append("empty robot with a grip")
    if s["robot"]["held"] and s["robot"]["slot"] not in ("A", "B"):
        out.append("held sample without source slot")
    return out


def need(*conditions: tuple[object, str]) -> Guard:
    yield from (problem for ok, problem in conditions if not ok)


def put(s: State, i: str, place: str) -> None:
    """Takes a sample out of whatever holds it and puts it elsewhere."""
    x = s["samples"][i]
    old = HOLDER_OF[x["place"]]
    if old == "prep":
        s["prep"] = {"sample": None, "status": "EMPTY"}
    elif old == "agv":
        s["agv"]["load"] = None
    elif old in ("A", "B"):
        s["slots"][old] = None
    elif old == "robot":
        s["robot"]["held"] = None
    x["place"] = place
    new = HOLDER_OF[place]
    if new == "agv":
        s["agv"]["load"] = i
    elif new in ("A", "B"):
        s["slots"][new] = i
    elif new == "robot":
        s["robot"]["held"] = i


def staged(x: dict | None, stage: str) -> bool:
    return x is None or x["stage"] == stage


def build_skills() -> dict[str, Skill]:
    table: list[Skill] = []
    add = lambda *a, **k: table.append(Skill(*a, **k))
    at = lambda s, place: s["agv"]["place"] == place
    for label, place in PLACES.items():
        add(f"move_agv_to_{label}", "agv", 2.0, 4, lambda s, a, p=place: need((not at(s, p), "already there"), (p != "STANDBY" or not s["agv"]["load"], "not empty")), lambda s, a, p=place: s["agv"].update(place=p))
    add("load_raw_from_shelf", "agv", 2.0, 2,
        lambda s, a: need((at(s, "SHELF"), "not at the shelf"), (not s["agv"]["load"], "not empty"), (a in s["samples"], "unknown sample"), (a not in s["samples"] or (s["samples"][a]["place"], s["samples"][a]["stage"]) == ("SHELF_RAW", "RAW"), "not raw on the shelf")),
        lambda s, a: put(s, a, "AGV"), parameter="sample_id")
    add("unload_raw_to_prep", "agv", 2.0, 2,
        lambda s, a: need((at(s, "PREP"), "not at preparation"), (s["agv"]["load"], "nothing carried"), (staged(carried(s), "RAW"), "not raw"), (s["prep"]["status"] == "EMPTY", "preparation occupied")),
        lambda s, a: (lambda i: (put(s, i, "PREP"), s.update(prep={"sample": i, "status": "RAW_LOADED"})))(s["agv"]["load"]))
    add("run_preparation_recipe", "prep", 5.0, 20, lambda s, a: need((s["prep"]["status"] == "RAW_LOADED" and s["prep"]["sample"], "no raw sample loaded")),
        lambda s, a: (s["samples"][s["prep"]["sample"]].update(stage="PREPARED"), s["prep"].update(status="READY")))
    add("load_prepared_from_prep", "agv", 2.0, 2, lambda s, a: need((at(s, "PREP"), "not at preparation"), (not s["agv"]["load"], "not empty"), (s["prep"]["status"] == "READY" and s["prep"]["sample"], "not ready")),
        lambda s, a: put(s, s["prep"]["sample"], "AGV"))
    for slot in "AB":
        add(f"unload_prepared_to_{slot}", "agv", 2.0, 2, lambda s, a, x=slot: need((at(s, "IR"), "not at the instrument"), (s["agv"]["load"], "nothing carried"), (staged(carried(s), "PREPARED"), "not prepared"), (not s["slots"][x], "slot occupied")),
            lambda s, a, x=slot: put(s, s["agv"]["load"], f"TRANSFER_{x}"))
    for slot in "AB":
        add(f"load_characterized_from_{slot}", "agv", 2.0, 2, lambda s, a, x=slot: need((at(s, "IR") and not s["agv"]["load"], "no empty vehicle here"), (s["slots"][x], "slot empty"), (staged(s["samples"].get(s["slots"][x]), "CHARACTERIZED"), "not characterized")),
            lambda s, a, x=slot: put(s, s["slots"][x], "AGV"))
    add("unload_characterized_to_shelf", "agv", 2.0, 2, lambda s, a: need((at(s, "SHELF"), "not at the shelf"), (s["agv"]["load"], "nothing carried"), (staged(carried(s), "CHARACTERIZED"), "not characterized")),
        lambda s, a: put(s, s["agv"]["load"], "SHELF_FINISHED"))
    add("run_background_capture", "software", 3.0, 1, lambda s, a: need(), lambda s, a: s.update(background=s["minute"]))
    add("select_protocol", "software", 1.0, 1, lambda s, a: need((a, "no protocol")), lambda s, a: s["instrument"].update(protocol=a), parameter="protocol")
    add("configure_sample_metadata", "software", 1.0, 1, lambda s, a: [*need((a in s["samples"], "unknown sample"))] or need((a in (s["robot"]["held"], *s["slots"].values()), "not at the instrument")),
        lambda s, a: s["instrument"].update(configured=a), parameter="sample_id")
    for slot in "AB":
        add(f"pick_mold_from_{slot}", "ir_robot", 2.0, 2, lambda s, a, x=slot: need((not s["robot"]["held"], "robot full"), (s["slots"][x], "slot empty"), (staged(s["samples"].get(s["slots"][x]), "PREPARED"), "not prepared")),
            lambda s, a, x=slot: (put(s, s["slots"][x], "ROBOT"), s["robot"].update(zone="LOADING_PLATFORM", slot=x, side=FRONT)))

    def measurable(s: State, site: int) -> Guard:
        yield from need((background_valid(s), "background not valid"), (held(s), "nothing held"))
        if x := held(s):
            yield from need(
                (s["instrument"]["protocol"] == x["protocol"], "other protocol"), (s["instrument"]["configured"] == s["robot"]["held"], "other sample configured"),
                (s["robot"]["side"] == (FRONT if site <= 3 else BACK), "other side up"), (site not in x["measured"], "measured before"),
            )

    def measure(s: State, site: int) -> None:
        x = held(s)
        x["measured"] = sorted([*x["measured"], site])
        s["robot"]["zone"] = "MEASUREMENT_STAGE"
        s["instrument"]["result"] = s["robot"]["held"]

    for site in range(1, 7):
        add(f"measure_site_{site}", "ir_robot", 4.0, 1, lambda s, a, k=site: measurable(s, k), lambda s, a, k=site: measure(s, k))
    for slot in "AB":
        add(f"switch_grip_side_at_{slot}", "ir_robot", 3.0, 3, lambda s, a, x=slot: [*need((held(s) and s["robot"]["slot"] == x, "not from this slot"))] or [*need((s["robot"]["side"] == FRONT, "front not up"))] or need(({1, 2, 3} <= set(held(s)["measured"]), "front not measured")),
            lambda s, a: s["robot"].update(zone="FLIP_STATION", side=BACK))
    add("save_measurement_result", "software", 2.0, 2, lambda s, a: [*need((held(s), "nothing held"))] or need((set(held(s)["sites"]) <= set(held(s)["measured"]), "sites missing"), (not held(s)["saved"], "saved before")),
        lambda s, a: (held(s).update(saved=True), s["instrument"].update(result=s["robot"]["held"])))
    add("verify_result_file", "software", 1.0, 1, lambda s, a: [*need((held(s), "nothing held"))] or need((held(s)["saved"], "not saved"), (s["instrument"]["result"] == s["robot"]["held"], "another sample's result")),
        lambda s, a: held(s).update(verified=True, stage="CHARACTERIZED"))
    for slot in "AB":
        add(f"place_mold_to_{slot}", "ir_robot", 2.0, 2, lambda s, a, x=slot: need((held(s) and s["robot"]["slot"] == x, "not from this slot"), (not s["slots"][x], "slot occupied")),
            lambda s, a, x=slot: (put(s, s["robot"]["held"], f"TRANSFER_{x}"), s.update(robot={"zone": "LOADING_PLATFORM", "held": None, "slot": None, "side": None})))
    add("return_to_wait_loading", "ir_robot", 1.0, 1, lambda s, a: need((not s["robot"]["held"], "something held")), lambda s, a: s.update(robot={"zone": "WAIT_LOADING", "held": None, "slot": None, "side": None}))
    add("poll_measurement_complete", "software", 1.0, 1, lambda s, a: need((s["instrument"]["run"] == "RUNNING", "not running"), (s["instrument"]["site"] in range(1, 7), "site unknown"), (held(s) and s["instrument"]["result"] == s["robot"]["held"], "another sample runs")),
        lambda s, a: (held(s).update(measured=sorted([*held(s)["measured"], s["instrument"]["site"]])), s["instrument"].update(run="IDLE", site=None)))
    return {k.name: k for k in table}


SKILLS = build_skills()
Action = tuple[str, str]  # skill, argument or ""


def attempt(s: State, action: Action) -> tuple[list[str], State]:
    """(problems, next state): the state itself if there are problems. Invariants are checked before and after."""
    skill = SKILLS.get(action[0])
    if skill is None:
        return ["unknown skill"], s
    if problems := [*broken(s)] or list(skill.guards(s, action[1])):
        return problems, s
    after = copy.deepcopy(s)
    skill.effect(after, action[1])
    # A background capture is stamped with the minute at which it began.
    after["minute"] += skill.minutes
    return (problems, s) if (problems := broken(after)) else ([], after)


def actions(s: State) -> list[Action]:
    """All candidate actions with their arguments filled in, by name."""
    out = []
    for k in SKILLS.values():
        if k.parameter == "sample_id":
            out += [(k.name, i) for i in sorted(s["samples"])]
        elif k.parameter == "protocol":
            out += [(k.name, p) for p in sorted({x["protocol"] for x in s["samples"].values()})]
        else:
            out.append((k.name, ""))
    return out


def satisfied(s: State, goal: dict, i: str) -> bool:
    x = s["samples"][i]
    done = set(x["sites"]) <= set(x["measured"]) and x["verified"] and x["stage"] == "CHARACTERIZED"
    return done and x["place"] in (("SHELF_FINISHED",) if goal["store"] else ("TRANSFER_A", "TRANSFER_B", "SHELF_FINISHED"))


def complete(s: State, goal: dict) -> bool:
    robot = s["robot"]["held"] is None and s["robot"]["zone"] == "WAIT_LOADING"
    parked = not goal["store"] or (s["agv"]["place"] == "STANDBY" and s["agv"]["load"] is None)
    return robot and parked and all(satisfied(s, goal, i) for i in goal["order"])


def go(s: State, label: str, then: Action) -> Action:
    return then if s["agv"]["place"] == PLACES[label] else (f"move_agv_to_{label}", "")


def next_action(s: State, goal: dict) -> Action | None:
    """The planner's greedy choice: finish what is in hand, else the next sample by priority."""
    busy = [i for i in (s["robot"]["held"], s["agv"]["load"], s["prep"]["sample"]) if i in goal["order"]]
    i = busy[0] if busy else next((i for i in goal["order"] if not satisfied(s, goal, i)), None)
    if i is None:
        if s["robot"]["zone"] != "WAIT_LOADING" and not s["robot"]["held"]:
            return "return_to_wait_loading", ""
        return ("move_agv_to_standby", "") if goal["store"] and s["agv"]["place"] != "STANDBY" and not s["agv"]["load"] else None
    x = s["samples"][i]
    setup = next((a for wrong, a in (
        (s["instrument"]["protocol"] != x["protocol"], ("select_protocol", x["protocol"])), (s["instrument"]["configured"] != i, ("configure_sample_metadata", i)),
        (not background_valid(s), ("run_background_capture", "")),
    ) if wrong), None)
    match x["place"], x["stage"]:
        case "SHELF_RAW", _:
            return go(s, "shelf", ("load_raw_from_shelf", i))
        case "AGV", "RAW":
            return go(s, "prep", ("unload_raw_to_prep", ""))
        case "AGV", "PREPARED":
            free = next((f"unload_prepared_to_{k}" for k in "AB" if not s["slots"][k]), None)
            return go(s, "ir", (free, "")) if free or s["agv"]["place"] != "IR" else None
        case "AGV", _:
            return go(s, "shelf", ("unload_characterized_to_shelf", ""))
        case "PREP", "RAW":
            return "run_preparation_recipe", ""
        case "PREP", _:
            return go(s, "prep", ("load_prepared_from_prep", ""))
        case ("TRANSFER_A" | "TRANSFER_B") as place, "CHARACTERIZED":
            if goal["store"]:
                return go(s, "ir", (f"load_characterized_from_{place[-1]}", ""))
            return ("return_to_wait_loading", "") if s["robot"]["zone"] != "WAIT_LOADING" else None
        case ("TRANSFER_A" | "TRANSFER_B") as place, _:
            return setup or (f"pick_mold_from_{place[-1]}", "")
        case "ROBOT", _:
            return in_hand(s, x, setup)
    return None


def in_hand(s: State, x: dict, setup: Action | None) -> Action:
    if s["instrument"]["run"] == "RUNNING":
        return "poll_measurement_complete", ""
    if setup:
        return setup
    # The back can only be reached after the whole front.
    wanted = set(x["sites"]) | ({1, 2, 3} if set(x["sites"]) & {4, 5, 6} else set())
    left = sorted(wanted - set(x["measured"]))
    side = [k for k in left if (k <= 3) == (s["robot"]["side"] == FRONT)]
    if side:
        return f"measure_site_{side[0]}", ""
    if left and s["robot"]["side"] == FRONT:
        return f"switch_grip_side_at_{s['robot']['slot']}", ""
    if not x["saved"]:
        return "save_measurement_result", ""
    return ("verify_result_file", "") if not x["verified"] else (f"place_mold_to_{s['robot']['slot']}", "")


def plan(s: State, goal: dict, limit: int = 120) -> tuple[bool, list[Action], list[State]]:
    """(whether the goal is reached, actions, states from the first on)."""
    done, states = [], [s]
    for _ in range(limit):
        if complete(s, goal):
            return True, done, states
        action = next_action(s, goal)
        problems, after = attempt(s, action) if action else (["no progress"], s)
        if problems:
            return False, done, states
        done.append(action)
        states.append(s := after)
    return complete(s, goal), done, states


def unchanged(before: State, after: State) -> bool:
    """Whether only the clock (and the minute of a background that was valid anyway) moved."""
    bare = lambda s: {k: v for k, v in s.items() if k != "minute"}
    return bare(before) == bare(after)

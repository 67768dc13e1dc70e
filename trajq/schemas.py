"""Fixed schemas of the tables that the library reads and writes."""

TILE_GRID = "map_id string, pos int, code int, x int, y int"
ZONE = "map_id string, zone_id long, kind string, x0 double, y0 double, x1 double, y1 double"
FRAME = (
    "run_id long, episode_id long, step long, ts timestamp, elapsed double, map_id string, "
    "x double, y double, heading double, vx double, vy double, action int"
)
HIT = "run_id long, episode_id long, step long, zone_id long, kind string"
RULE = "stage int, kind string, base double, bonus double, gate_axis string, gate_sign int, terminal boolean"
TRANSITION = "run_id long, episode_id long, step long, state string, action int, reward double, next_state string, done boolean"
Q = "state string, action int, q double"
EPISODE = "run_id long, episode_id long, steps long, reward double, success boolean, epsilon double, duration double, end_reason string"

# Tile codes, milestone rules and actions.
CODES = [(1, "side"), (2, "wall"), (3, "track"), (4, "finish"), (5, "checkpoint1"), (6, "checkpoint2"), (7, "checkpoint3")]
RULES = [
    (1, "checkpoint1", 1000.0, 500.0, "x", 1, True),
    (2, "checkpoint2", 10000.0, 2500.0, "x", 1, True),
    (3, "checkpoint3", 50000.0, 5000.0, "x", 1, True),
    (4, "finish", 100000000.0, 10000.0, "y", 1, True),
]
ACTIONS = [(0,), (1,), (2,)]
START_STATE = "<start>"
EPISODE_KEYS = ["run_id", "episode_id"]
FRAME_KEYS = ["run_id", "episode_id", "step"]

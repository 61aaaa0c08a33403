"""Score tables, class names and report texts.

They are published assessment tables and report wording, stated as they are because results must equal them.
"""

# ---- fixed values: COCO keypoint positions ----
NOSE = 0
L_SHOULDER, R_SHOULDER = 5, 6
L_ELBOW, R_ELBOW = 7, 8
L_WRIST, R_WRIST = 9, 10
L_HIP, R_HIP = 11, 12
L_KNEE, R_KNEE = 13, 14
L_ANKLE, R_ANKLE = 15, 16

# ---- fixed values: posture labels ----
LABELS = ["sitting", "squatting", "standing", "bending", "walking", "unknown"]

# ---- fixed values: work-relevant COCO classes ----
WORK_CLASSES = {
    0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck", 24: "backpack", 26: "handbag",
    28: "suitcase", 39: "bottle", 43: "knife", 56: "chair", 57: "couch", 58: "potted plant", 73: "book",
    76: "scissors",
}
LOAD_CLASSES = ["backpack", "handbag", "suitcase"]

# ---- fixed values: accepted video formats ----
VIDEO_FORMATS = [".mp4", ".avi", ".mov", ".mkv", ".wmv"]

# ---- fixed values: sampling rate by mode and video length (<180 s, <900 s, longer) ----
SAMPLING_FPS = {
    "Lightning": (0.5, 0.25, 0.15),
    "Precision": (3.0, 1.5, 1.0),
    "Balanced": (1.0, 0.5, 0.25),
}
SAMPLING_BANDS = (180.0, 900.0)

# ---- fixed values: REBA angle ranges (from, below, score), in matching order ----
REBA_RANGES = {
    "trunk": [(0, 5, 1), (5, 20, 2), (20, 60, 3), (60, 180, 4)],
    "neck": [(0, 20, 1), (20, 180, 2)],
    "legs": [(0, 30, 1), (30, 60, 2), (60, 180, 3)],
    "upper_arm": [(0, 20, 1), (20, 45, 2), (45, 90, 3), (90, 180, 4)],
    "lower_arm": [(60, 100, 1), (0, 60, 2), (100, 180, 2)],
    "wrist": [(0, 15, 1), (15, 180, 2)],
}

# ---- fixed values: REBA tables A (trunk, neck, legs), B (upper arm, lower arm, wrist), C (A, B) ----
REBA_A = [
    [[1, 2, 3, 4], [2, 3, 4, 5]],
    [[2, 3, 4, 5], [3, 4, 5, 6]],
    [[2, 4, 5, 6], [4, 5, 6, 7]],
    [[3, 5, 6, 7], [5, 6, 7, 8]],
    [[4, 6, 7, 8], [6, 7, 8, 9]],
]
REBA_B = [
    [[1, 2], [2, 3]],
    [[1, 2], [3, 4]],
    [[3, 4], [5, 5]],
    [[4, 5], [5, 6]],
    [[6, 7], [7, 8]],
    [[7, 8], [8, 9]],
]
REBA_C = [
    [1, 1, 1, 2, 3, 3, 4, 5, 6, 7, 7, 7],
    [1, 2, 2, 3, 4, 4, 5, 6, 6, 7, 7, 8],
    [2, 3, 3, 3, 4, 5, 6, 7, 7, 8, 8, 8],
    [3, 4, 4, 4, 5, 6, 7, 8, 8, 9, 9, 9],
    [4, 4, 4, 5, 6, 7, 8, 8, 9, 9, 9, 9],
    [6, 6, 6, 7, 8, 8, 9, 9, 10, 10, 10, 10],
    [7, 7, 7, 8, 9, 9, 9, 10, 10, 11, 11, 11],
    [8, 8, 8, 9, 10, 10, 10, 10, 10, 11, 11, 11],
    [9, 9, 9, 10, 10, 10, 11, 11, 11, 12, 12, 12],
    [10, 10, 10, 11, 11, 11, 11, 12, 12, 12, 12, 12],
    [11, 11, 11, 11, 12, 12, 12, 12, 12, 12, 12, 12],
    [12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12],
]
REBA_LEVELS = [
    (1, 1, "Negligible", "None necessary"),
    (2, 3, "Low", "May be necessary"),
    (4, 7, "Medium", "Necessary"),
    (8, 10, "High", "Necessary soon"),
    (11, 15, "Very High", "Necessary NOW"),
]

# ---- fixed values: RULA tables A (upper arm, lower arm, wrist), B (neck, trunk, legs), C (A, B) ----
RULA_A = [
    [[1, 2, 2, 3], [2, 2, 3, 3], [2, 3, 3, 4]],
    [[2, 3, 3, 4], [3, 3, 4, 4], [3, 4, 4, 5]],
    [[3, 3, 4, 4], [4, 4, 4, 5], [4, 4, 5, 5]],
    [[4, 4, 4, 5], [4, 4, 5, 5], [4, 5, 5, 6]],
    [[5, 5, 5, 6], [5, 6, 6, 7], [6, 6, 7, 7]],
    [[7, 7, 7, 8], [8, 8, 8, 9], [9, 9, 9, 9]],
]
RULA_B = [
    [[1, 3], [2, 3], [3, 4], [5, 5], [6, 6], [7, 7]],
    [[2, 3], [3, 4], [4, 5], [5, 5], [6, 7], [7, 7]],
    [[3, 3], [3, 4], [4, 5], [5, 6], [6, 7], [7, 7]],
    [[5, 5], [5, 6], [6, 7], [7, 7], [7, 7], [8, 8]],
    [[7, 7], [7, 7], [7, 8], [8, 8], [8, 8], [8, 8]],
    [[8, 8], [8, 8], [8, 8], [8, 9], [9, 9], [9, 9]],
]
RULA_C = [
    [1, 2, 3, 3, 4, 5, 5],
    [2, 2, 3, 4, 4, 5, 5],
    [3, 3, 3, 4, 4, 5, 6],
    [3, 3, 3, 4, 5, 6, 6],
    [4, 4, 4, 5, 6, 7, 7],
    [4, 4, 5, 6, 6, 7, 7],
    [5, 5, 6, 6, 7, 7, 7],
    [5, 5, 6, 7, 7, 7, 7],
]
RULA_LEVELS = [
    (1, 2, "Acceptable", "Posture is acceptable if not maintained/repeated for long periods"),
    (3, 4, "Investigate Further", "Further investigation is needed and changes may be required"),
    (5, 6, "Investigate & Change Soon", "Investigation and changes are required soon"),
    (7, 7, "Investigate & Change Immediately", "Investigation and changes are required IMMEDIATELY"),
]

# ---- fixed values: task catalogue (name, description, hazard) ----
TASKS = {
    "transport": (
        "Crop Transport / Load Carrying",
        "Manual carrying of harvested crop crates, bags, or buckets.",
        "L5/S1 lumbar disc compression & excessive cardiac load.",
    ),
    "weeding": (
        "Manual Weeding / Ground Harvesting",
        "Ground-level crop picking or weeding involving stooping/squatting posture.",
        "High lower back flexion stress & knee joint compression.",
    ),
    "hoeing": (
        "Land Tilling / Hoeing",
        "Soil cultivation using manual tools (hoe, spade).",
        "Repetitive spinal impact & high physical drudgery.",
    ),
    "picking": (
        "Overhead Fruit Harvesting / Picking",
        "Tree or elevated crop harvesting involving shoulder extension.",
        "Upper limb & neck extension stress.",
    ),
    "pruning": (
        "Crop Pruning & Cutting",
        "Precision cutting/pruning using shears or sickles.",
        "Repetitive hand-wrist fatigue & carpal tunnel strain.",
    ),
    "general": (
        "General Agricultural Work",
        "Mixed field activity including walking, standing, and light handling.",
        "General physical fatigue.",
    ),
}

# ---- fixed values: report texts ----
ADVICE_ARM = "Reduce overhead reaching and elevated arm posture using adjustable trestles or step platforms."
ADVICE_POSTURE = "Implement long-handled tools to reduce trunk stooping/bending."
ADVICE_REPEAT = "Introduce micro-break cycles (1 min rest every 15 mins of repetitive motion)."
ADVICE_REST = "Increase scheduled rest duration between long continuous work bouts."
ADVICE_LOAD = "Use wheelbarrows or mechanical carrying aids to reduce manual load stress."
ADVICE_NONE = "Current work setup and posture distribution are within safe ergonomic limits."

LIFT_LOW = ("Low Risk (Safe)", "Lifting task is within safe NIOSH biomechanical guidelines.")
LIFT_MODERATE = (
    "Moderate Risk",
    "Reduce load distance or reduce forward trunk flexion to protect lumbar spine.",
)
LIFT_HIGH = (
    "High Risk (Severe Spinal Strain)",
    "CRITICAL: Spinal compression exceeds safe 3.4 kN limit! Implement mechanical lifting assistance or redesign task.",
)

ISO_NO_DATA = "Insufficient shift data"
ISO_BAD = (
    "ISO 11226 Hazard Warning: Sustained severe trunk bending (",
    " mins / 30-min shift) exceeds the 4-minute ergonomic limit!",
)
ISO_OK = (
    "ISO 11226 Compliant: Trunk flexion exposure (",
    " mins / 30-min shift) is within safe static limits.",
)

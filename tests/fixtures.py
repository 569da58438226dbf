"""Small made-up inputs."""

import numpy as np

# Classifier rows (drift, cloud_t1, cloud_t2, days, month_t1, month_t2); similarity is 1 - drift.
REAL_CHANGES = [
    (0.284, 0.02, 0.03, 375, 12, 12),
    (0.312, 0.04, 0.05, 375, 12, 12),
    (0.265, 0.01, 0.04, 375, 12, 12),
    (0.228, 0.03, 0.02, 300, 11, 9),
    (0.245, 0.05, 0.03, 375, 12, 12),
    (0.215, 0.02, 0.06, 240, 10, 6),
    (0.273, 0.04, 0.02, 365, 12, 12),
    (0.342, 0.01, 0.03, 375, 12, 12),
    (0.198, 0.03, 0.04, 180, 1, 7),
    (0.320, 0.02, 0.05, 270, 3, 12),
    (0.205, 0.06, 0.04, 210, 2, 9),
    (0.252, 0.02, 0.02, 375, 12, 12),
    (0.290, 0.03, 0.05, 330, 11, 10),
    (0.238, 0.04, 0.03, 375, 12, 12),
]
FALSE_ALARMS = [
    (0.175, 0.02, 0.03, 15, 12, 12),
    (0.220, 0.03, 0.28, 375, 12, 12),
    (0.165, 0.02, 0.04, 30, 1, 2),
    (0.185, 0.05, 0.04, 180, 4, 10),
    (0.240, 0.31, 0.05, 60, 8, 10),
    (0.155, 0.04, 0.03, 120, 1, 5),
    (0.142, 0.07, 0.22, 375, 12, 12),
    (0.168, 0.02, 0.03, 45, 11, 12),
    (0.210, 0.02, 0.25, 90, 2, 5),
    (0.192, 0.04, 0.05, 150, 12, 5),
    (0.128, 0.03, 0.02, 10, 12, 12),
    (0.195, 0.26, 0.03, 375, 12, 12),
    (0.150, 0.02, 0.03, 180, 10, 4),
    (0.178, 0.05, 0.06, 60, 7, 9),
]


def labelled_pairs(spark):
    """The 28 classifier rows as a table."""
    rows = []
    for label, group in ((1, REAL_CHANGES), (0, FALSE_ALARMS)):
        for drift, c1, c2, days, m1, m2 in group:
            rows.append((f"{label}-{len(rows)}", drift, 1 - drift, c1, c2, days, m1, m2, label))
    return spark.createDataFrame(
        rows,
        "pair_id string, drift double, similarity double, cloud_t1 double, cloud_t2 double, "
        "days_between int, month_t1 int, month_t2 int, label int",
    )


def planted_scenes(size=32, seed=42):
    """Two 4-band scenes of 2 x 2 tiles: three tiles change, the last one only gains noise.

    Returns {scene_id: array(4, 2 * size, 2 * size)} with bands R, G, B, NIR.
    """
    rng = np.random.default_rng(seed)

    def area(ranges):
        return np.stack([rng.integers(lo, hi, (size, size)) for lo, hi in ranges])

    forest = area([(30, 55), (150, 210), (30, 60), (210, 255)])
    canopy = area([(40, 60), (140, 200), (40, 60), (200, 250)])
    soil = area([(150, 190), (120, 150), (80, 110), (110, 140)])
    urban = area([(120, 160), (120, 160), (120, 160), (90, 120)])
    concrete = area([(170, 205), (170, 205), (170, 205), (80, 110)])
    bare = area([(180, 215), (105, 135), (65, 90), (75, 105)])
    water = area([(20, 45), (60, 95), (185, 230), (10, 30)])
    noise = urban + rng.integers(-4, 4, urban.shape)
    first = np.concatenate([np.concatenate([forest, canopy], 2), np.concatenate([soil, urban], 2)], 1)
    second = np.concatenate([np.concatenate([concrete, bare], 2), np.concatenate([water, noise], 2)], 1)
    return {1: first, 2: second}


def pixel_rows(scenes):
    """Scenes as long rows (scene_id, y, x, r, g, b, nir)."""
    out = []
    for scene_id, bands in scenes.items():
        _, height, width = bands.shape
        for y in range(height):
            for x in range(width):
                out.append((scene_id, y, x, *[int(v) for v in bands[:, y, x]]))
    return out

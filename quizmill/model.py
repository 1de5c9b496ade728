"""Constants of the exam model."""

from __future__ import annotations

# Question ranges of the parts with their group sizes.
PART_RANGES = {1: (1, 6, None), 2: (7, 31, None), 3: (32, 70, 3), 4: (71, 100, 3), 5: (101, 130, None), 6: (131, 146, 4), 7: (147, 200, None)}
# First questions of the listening groups that may carry a graphic.
GRAPHIC_STARTS = {3: (62, 65, 68), 4: (92, 95, 98)}
LISTENING_PARTS = (1, 2, 3, 4)
READING_PARTS = (5, 6, 7)
MOST_PER_SKILL = 495
#: Words and wrong answers that one enrichment call takes.
ENRICH_BATCH = 30
LEAST_BOX = 0.02
LEAST_OVERLAP = 0.3
LINE_TOLERANCE = 0.012
REVIEW_BELOW = 0.9
REQUIRED_ROLES = ("EXAM_DOC", "LISTENING_KEY_DOC", "READING_KEY_IMAGE", "AUDIO_FILE")


def expected_counts() -> dict[int, int]:
    return {part: last - first + 1 for part, (first, last, _) in PART_RANGES.items()}

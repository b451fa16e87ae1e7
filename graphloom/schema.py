"""Shared names, vocabularies and defaults."""

from __future__ import annotations

# Formats and vocabularies that results must agree on.
SEP = "<SEP>"
FIELD = "<|#|>"
COMPLETE = "<|COMPLETE|>"
UNKNOWN = "UNKNOWN"
DIM1_TYPES = ("数据结构", "算法思想", "动态规划", "图论", "搜索", "字符串", "数学", "计算几何")
DIM2_TYPES = ("概念", "技巧", "实现", "模型", "算法", "原理", "题目")
OTHER_TYPE = "其他"
PROBLEM_TYPE = "题目"
RELATION_TYPES = ("IS_A", "PART_OF", "BASED_ON", "APPLIES_TO", "EVALUATES", "EXPLAINS", "PRACTICED_BY", "COMPARES_WITH", "LEADS_TO", "OPTIMIZES", "TRANSFORMS_TO")
DOC_STATUSES = ("pending", "processing", "preprocessed", "processed", "failed")

# Defaults of queries.
TOP_K = 40
CHUNK_TOP_K = 20
RELATED_CHUNKS = 5
MAX_ENTITY_TOKENS = 6000
MAX_RELATION_TOKENS = 8000
MAX_TOTAL_TOKENS = 30000
COSINE_THRESHOLD = 0.2
RESULT_CAP = 30
NAME_LIMIT = 256
SOURCE_IDS_LIMIT = 300

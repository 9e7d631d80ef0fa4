"""What deliveries show: columns of each kind, displayed values, readable texts."""

from __future__ import annotations

import json
from typing import Any

from evidra.plans import contract as C

# Columns of all records, and of sources, questions and tests.
COMMON = [("id", "稳定ID"), ("name", "名称"), ("definition", "业务定义"), ("status", "评审状态"), ("evidence", "证据JSON"), ("links", "关联ID列表JSON")]
OTHERS = {
    "sources": [("id", "来源ID"), ("path", "文件路径"), ("kind", "来源性质"), ("version", "来源版本"), ("sha256", "文件哈希"), ("blocks_path", "解析件路径")],
    "questions": [("id", "问题ID"), ("question", "问题"), ("blocking", "是否阻塞"), ("status", "处理状态"), ("affects", "影响ID列表JSON"), ("resolution", "处理决定")],
    "tests": [("id", "验收ID"), ("question", "业务问题"), ("expected", "预期结果"), ("record_ids", "关联ID列表JSON"), ("result", "验证结果"), ("evidence", "验证记录")],
}
SHEET_NAMES = {"sources": "资料来源", "questions": "待确认问题", "tests": "业务验收"}
# Details shown beside those a kind needs.
FIRST = ["domain", "nature", "scope"]
FURTHER = {
    "relation": ["time_basis", "condition"], "rule": ["time_basis", "owner"], "metric": ["currency", "unknown_handling"], "action": ["inputs", "outputs", "state_from", "state_to"],
    "mapping": ["source_table", "source_field", "external_iri", "reference_version", "alignment"], "object": ["classification", "owner"], "state": ["owner_id"], "role": ["owner_id", "condition"],
}
_NAMED = ["model_level", "iri", "term_name", "labels"]
_CLASS = [*_NAMED, "synonyms", "parent_ids", "equivalent_ids", "disjoint_ids", "instance_of_ids"]
_PROPERTY = [*_NAMED, "property_type", "domain_ids", "range_ids", "allowed_values", "unit"]
SEMANTIC = {
    "concept": _CLASS, "object": _CLASS, "role": _CLASS, "attribute": _PROPERTY, "relation": _PROPERTY,
    "information_unit": ["about_ids", "related_unit_ids", "exception_unit_ids", "effective_from", "effective_to"],
    "constraint": ["time_basis", "verification_owner", "conformance_basis", "interpretation"],
}
# Readable words for codes.
WORDS = {"open": "待处理", "resolved": "已解决", "not_run": "未执行", "pass": "通过", "fail": "未通过", "draft": "草案", "baseline": "实施基线", **C.STATES}
TEST_WORDS = {"passed_with_evidence": "通过且有验证记录", "passed_without_evidence": "声明通过，依据不足", "not_run": "未执行", "failed": "未通过", "invalid": "状态无效"}
DETAIL_WORDS = {
    "model_level": {"class": "类", "individual": "实例", "property": "属性", "statement": "陈述"},
    "property_type": {"data": "数据属性", "object": "对象属性"},
    "unit_type": {"requirement": "要求", "recommendation": "建议", "instruction": "指示", "permission": "允许", "statement": "陈述", "definition": "定义", "example": "示例", "note": "注释", "other": "其他"},
    "statement_nature": {"normative": "规范性内容", "fact": "事实", "proposed": "拟议内容", "example": "示例", "modeling_decision": "建模决定", "unknown": "待确认"},
    "constraint_type": {"unique": "唯一性", "cardinality": "基数", "value_range": "数值范围", "enumeration": "枚举", "date_order": "日期顺序", "disjoint": "互斥", "reference": "引用", "custom": "自定义"},
    "representation": {"text": "文本", "table": "表格", "figure": "图", "formula": "公式"},
    "operator": {"lt": "早于", "le": "不晚于"},
    "policy": {"must_exist": "必须存在", "allow_external": "允许外部引用", "requires_resolution": "需要解析确认"},
}
KEY_WORDS = {"zh": "中文", "en": "英文", "min": "下限", "max": "上限", "min_inclusive": "包含下限", "max_inclusive": "包含上限", "values": "允许值", "scope": "适用范围", "operator": "顺序关系", "policy": "引用策略", "expression": "表达式", "language": "表达语言"}


def columns(kind: str, version: int = 2) -> list[tuple[str, str]]:
    """(field, heading) of a kind's sheet: common ones, then details, each once."""
    keys = [*FIRST, *C.REQUIRED.get(kind, []), *FURTHER.get(kind, [])]
    if version >= 2:
        keys += ["source_unit_ids", *SEMANTIC.get(kind, [])]
    return COMMON + [(f"details.{k}", C.DETAILS.get(k, k)) for k in dict.fromkeys(keys)]


def field(record: dict[str, Any], name: str) -> Any:
    inner = record.get("details", {}) if name.startswith("details.") else record
    return inner.get(name.removeprefix("details."))


def display(value: Any) -> str:
    if value is None:
        return ""
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list | bool) else str(value)


def readable(value: Any, words: dict[str, str] = WORDS, keys: dict[str, str] | None = None, empty: str = "") -> str:
    """Codes as words, lists and objects as phrases."""
    if isinstance(value, bool):
        return "是" if value else "否"
    if isinstance(value, list):
        return "；".join(readable(x, words, keys, empty) for x in value) or empty
    if isinstance(value, dict):
        return "；".join(f"{(keys or {}).get(k, k)}：" + readable(x, DETAIL_WORDS.get(k, {}) if keys else words, keys, empty) for k, x in value.items()) or empty
    return words.get(str(value), display(value))


def detail(key: str, value: Any) -> str:
    return readable(value, DETAIL_WORDS.get(key, {}), KEY_WORDS, "未登记")


def heading(key: str) -> str:
    return C.DETAILS.get(key, key).removesuffix("JSON")


def evidence(e: dict[str, Any]) -> str:
    shown = f"{e['source_id']} @ {e['anchor']}"
    if "field" in e:
        own = {"name": "名称", "definition": "业务定义"}
        shown += f"〔{own.get(e['field']) or heading(e['field'].removeprefix('details.'))}〕"
    return shown


def proven(value: Any) -> bool:
    """Whether a string that is not blank stands anywhere in the value."""
    if isinstance(value, str):
        return bool(value.strip())
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return any(map(proven, inner))


def test_status(t: dict[str, Any]) -> str:
    if t.get("result") == "pass":
        return "passed_with_evidence" if proven(t.get("evidence")) else "passed_without_evidence"
    return {"not_run": "not_run", "fail": "failed"}.get(str(t.get("result")), "invalid")

"""The model contract: closed vocabularies and which details each kind of record needs."""

# Schema versions and states.
VERSIONS = ["1.0", "1.1"]
PROJECT_STATES = ["draft", "baseline"]
PROJECT_FIELDS = ["id", "title", "version", "purpose", "domains", "application", "owner"]
COLLECTIONS = ["records", "sources", "questions", "tests", "decisions"]
REVISED = ["records", "questions", "tests", "sources"]
REVISED_PROJECT_FIELDS = ["title", "purpose", "domains", "application", "owner"]

# Kinds of records with their labels; the last two need version 1.1.
KINDS = {
    "concept": "概念", "object": "业务对象", "role": "业务角色", "attribute": "属性", "relation": "关系", "event": "事件", "state": "状态",
    "rule": "业务规则", "metric": "指标", "decision": "决策", "action": "业务动作", "mapping": "来源映射",
    "information_unit": "信息单元", "constraint": "业务约束",
}
NEW_KINDS = ["information_unit", "constraint"]
# Review states with their labels.
STATES = {"candidate": "待确认", "reviewed": "已评审", "approved": "已确认", "deprecated": "已废弃"}

# Labels of details.
DETAILS = {
    "domain": "业务领域", "identity": "身份判定", "classification": "分类依据", "scope": "适用范围", "nature": "陈述性质",
    "subject": "主体ID", "object": "客体ID", "owner_id": "所属对象ID", "target": "目标ID", "cardinality": "业务基数",
    "datatype": "值类型", "unit": "计量单位", "currency": "币种口径", "time_basis": "时间口径", "allowed_values": "允许值",
    "condition": "适用条件", "expression": "规则或计算表达", "exceptions": "例外情形", "positive_case": "正例", "negative_case": "反例",
    "unknown_handling": "缺失信息处理", "inputs": "所需输入", "outputs": "产出", "actor": "参与角色", "authorization": "权限与审批",
    "preconditions": "前置条件", "effects": "业务效果", "failure": "失败处理", "success": "成功判定", "idempotency": "重复执行处理",
    "state_from": "原状态ID", "state_to": "目标状态ID", "trigger": "触发条件", "source_table": "来源表", "source_field": "来源字段",
    "transformation": "映射逻辑", "coverage": "覆盖范围", "external_iri": "参考IRI", "reference_version": "参考版本", "alignment": "对齐方式",
    "rationale": "建模理由", "owner": "业务责任", "decision_id": "所支持决策ID",
    "iri": "语义IRI", "term_name": "规范名称", "labels": "可读标签JSON", "synonyms": "同义词列表JSON", "model_level": "建模层次",
    "parent_ids": "父类ID列表JSON", "equivalent_ids": "等价类ID列表JSON", "disjoint_ids": "互斥类ID列表JSON",
    "instance_of_ids": "所属类ID列表JSON", "property_type": "属性类型", "domain_ids": "定义域ID列表JSON", "range_ids": "值域类ID列表JSON",
    "source_unit_ids": "依据信息单元ID列表JSON", "content": "原文内容", "unit_type": "信息单元类型", "statement_nature": "陈述性质",
    "representation": "表述形式列表JSON", "about_ids": "涉及对象ID列表JSON", "related_unit_ids": "引用信息单元ID列表JSON",
    "exception_unit_ids": "例外信息单元ID列表JSON", "constraint_type": "约束类别", "target_ids": "约束目标ID列表JSON",
    "specification": "约束规格JSON", "effective_from": "生效日期", "effective_to": "失效日期", "verification_owner": "验证责任",
    "conformance_basis": "标准条款依据", "interpretation": "解释与适用边界",
}

# Details that refer to one record, and those that list records.
REFERENCE_FIELDS = ["subject", "object", "owner_id", "target", "state_from", "state_to", "decision_id"]
REFERENCE_LISTS = [
    "source_unit_ids", "parent_ids", "equivalent_ids", "disjoint_ids", "instance_of_ids", "domain_ids", "range_ids", "target_ids",
    "about_ids", "related_unit_ids", "exception_unit_ids",
]
UNIT_LISTS = ["source_unit_ids", "related_unit_ids", "exception_unit_ids"]
CLASS_LISTS = ["parent_ids", "equivalent_ids", "disjoint_ids", "instance_of_ids", "domain_ids", "range_ids"]
IRREFLEXIVE_LISTS = ["parent_ids", "disjoint_ids", "instance_of_ids"]

# Details that a record of each kind needs.
REQUIRED = {
    "object": ["identity"],
    "relation": ["subject", "object", "cardinality"],
    "attribute": ["owner_id", "datatype"],
    "rule": ["condition", "expression", "exceptions", "unknown_handling", "positive_case", "negative_case"],
    "metric": ["expression", "scope", "unit", "time_basis"],
    "event": ["subject", "trigger", "time_basis"],
    "action": ["actor", "authorization", "preconditions", "effects", "failure", "success", "idempotency"],
    "decision": ["inputs", "outputs", "actor"],
    "mapping": ["target", "transformation", "coverage"],
    "information_unit": ["content", "unit_type", "statement_nature", "representation"],
    "constraint": ["constraint_type", "target_ids", "specification", "condition", "exceptions", "unknown_handling", "positive_case", "negative_case"],
}
# Levels of modelling, kinds of units, natures of statements.
LEVELS = ["class", "individual", "property", "statement"]
UNIT_TYPES = ["requirement", "recommendation", "instruction", "permission", "statement", "definition", "example", "note", "other"]
NATURES = ["normative", "fact", "proposed", "example", "modeling_decision", "unknown"]
SEMANTIC_KINDS = ["concept", "object", "role", "attribute", "relation"]
RESULTS = ["not_run", "pass", "fail"]
# Errors that don't stop a revision.
TOLERATED = ["missing_reference", "unapproved", "approval_missing", "test_not_passed", "open_blocker", "detail_missing", "no_evidence"]

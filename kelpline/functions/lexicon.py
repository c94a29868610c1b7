"""Tag pools, rules and maps of the knowledge base. Functions take them as parameters."""

from __future__ import annotations

TAG_POOL = {
    "semantic_tags": [
        "死亡焦虑", "未竟事务", "预后不确定", "照护负担", "存在性痛苦", "生命意义", "告别与分离", "哀伤与丧失",
        "疼痛管理", "呼吸困难", "恶心呕吐", "疲劳与虚弱", "认知障碍", "谵妄", "抑郁情绪", "自杀意念",
        "灵性需求", "宗教需求", "文化敏感性", "家属沟通", "医疗决策", "预立医疗计划", "居家安宁", "住院安宁",
        "转诊决策", "儿童安宁", "老年安宁", "癌症末期",
    ],
    "scenario_tags": [
        "夜间焦虑", "告别沟通", "治疗拒绝", "呼吸困难", "疼痛发作", "情绪崩溃", "家属冲突", "病情告知",
        "临终决策", "死亡准备", "哀伤辅导", "初次诊断", "复发告知", "转安宁病房", "出院计划",
    ],
    "role_tags": ["patient", "family", "nurse"],
    "method_tags": [
        "正念", "叙事疗法", "尊严疗法", "意义中心疗法", "认知行为疗法", "放松训练", "呼吸练习", "音乐疗法",
        "艺术疗法", "宠物疗法", "家庭会议", "动机访谈", "危机干预", "疼痛评估", "症状评估", "心理评估",
        "生命回顾", "遗愿清单", "告别仪式",
    ],
    "risk_levels": ["low", "medium", "high"],
    "card_targets": ["mindfulness", "healing", "communication", "personalized"],
}

SAFETY_RULES = {
    "呼吸困难": ["呼吸困难", "呼吸窘迫", "气促", "喘息"],
    "自杀意念": ["自杀", "绝望", "不想活", "结束生命"],
    "疼痛危象": ["剧烈疼痛", "疼痛难忍", "疼痛控制"],
    "谵妄": ["谵妄", "意识模糊", "躁动"],
}

#: Kinds of manifest rows; None is skipped, and so is a kind that isn't here.
SOURCE_KINDS = {
    "guideline": "guideline",
    "consensus": "guideline",
    "standard": "guideline",
    "patient_guide": "guideline",
    "patient_education": "guideline",
    "patient_guideline": "guideline",
    "guideline_update": "guideline",
    "international_guideline": "guideline",
    "patient_professional_summary": "guideline",
    "guideline_insight": "guideline",
    "book_guideline": "guideline",
    "article": "paper",
    "method_paper": None,
    "technical_reference": None,
    "ai_governance": None,
    "reporting_guideline": None,
    "historical_guideline": "guideline",
}

PRIORITY_STATUS = {"P0": "main", "P1": "main", "P2": "candidate"}
STATUSES = ["main", "candidate", "quarantined"]
UNIT_TYPES = ["semantic_chunk", "knowledge_card"]
SOURCE_TYPES = ["pdf_book", "paper", "guideline", "case", "structured_library", "markdown", "web_reference"]
REVIEW_STATUSES = ["unreviewed", "approved", "rejected"]
CARD_TARGETS = ["mindfulness", "healing", "communication", "personalized"]
SOURCE_WEIGHTS = {"main": 0.05, "candidate": 0.025, "quarantined": 0.0}
COPYRIGHT_MARKS = ["ISBN", "CIP", "版权", "Copyright", "出版社", "印次", "版次"]
CONTENTS_MARKS = ["目录", "Contents", "目  录"]
#: Lowest or highest value of each metric that passes; None has no target.
TARGETS = {
    "recall_at_10": (">=", 0.70),
    "safety_hit_rate": (">=", 0.95),
    "noise_rate": ("<=", 0.15),
    "avg_tag_match": None,
    "avg_source_type_match": (">=", 0.80),
    "avg_flag_check": (">=", 0.95),
    "avg_card_target_match": None,
}

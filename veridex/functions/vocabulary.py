"""Controlled vocabularies. All entries are fixed values that results depend on; engines may pass their own tables."""

STOP_WORDS = [
    "的", "了", "和", "与", "或", "是否", "如何", "什么", "哪些", "有", "对", "在", "患者", "病人", "研究", "证据", "指南", "治疗", "用药",
    "the", "a", "an", "of", "and", "or", "to", "in", "for", "with", "is", "are", "what", "how",
]

DOMAINS = {
    "高血压": ["高血压", "血压", "降压", "hypertension", "antihypertensive", "acei", "arb", "ccb", "利尿剂"],
    "血脂": ["血脂", "胆固醇", "ldl", "hdl", "甘油三酯", "他汀", "statin", "lipid", "cholesterol"],
    "糖尿病": ["糖尿病", "血糖", "胰岛素", "glp-1", "sglt2", "diabetes", "metformin", "二甲双胍"],
    "脑卒中": ["卒中", "中风", "tia", "脑梗", "脑出血", "stroke", "阿司匹林", "氯吡格雷"],
    "心脑血管": ["心血管", "冠心病", "心梗", "心衰", "动脉粥样硬化", "ascvd", "cardiovascular", "地中海饮食", "限钠", "低盐"],
}

TOPIC_KEYWORDS = {
    "高血压": ["hypertension", "blood pressure", "antihypertensive"],
    "糖尿病": ["diabetes", "glycemic", "glucose", "insulin", "sglt2", "glp-1"],
    "脑卒中": ["stroke", "cerebrovascular", "transient ischemic", "intracerebral"],
    "血脂": ["lipid", "lipoprotein", "cholesterol", "triglyceride", "statin", "dyslipidemia"],
    "心脑血管": ["cardiovascular", "coronary", "atherosclerosis", "myocardial", "heart failure"],
}

TRANSLATIONS = {
    "高血压": "hypertension antihypertensive treatment", "血压": "blood pressure", "降压药": "antihypertensive medication", "血脂": "dyslipidemia lipid management",
    "胆固醇": "cholesterol", "他汀": "statin", "糖尿病": "type 2 diabetes mellitus", "肥胖": "obesity weight management", "脑卒中": "stroke secondary prevention",
    "卒中": "stroke", "中风": "stroke", "阿司匹林": "aspirin", "氯吡格雷": "clopidogrel", "地中海饮食": "Mediterranean diet", "限钠": "dietary sodium reduction",
    "低盐": "dietary sodium reduction", "早上": "morning dosing", "睡前": "bedtime dosing", "肌肉": "muscle symptoms", "副作用": "adverse effects",
}

CONCEPTS = {
    "mediterranean": ["地中海饮食", "mediterranean diet"],
    "sodium": ["限钠", "低盐", "钠摄入", "尿钠", "sodium"],
    "dosing_time": ["早上服用", "早晨服用", "晚间服用", "晚上服用", "睡前服用", "服药时间", "早上", "早晨", "晚间", "晚上", "睡前", "morning dosing", "bedtime dosing"],
    "antihypertensive": ["降压药", "抗高血压药", "antihypertensive"],
    "statin": ["他汀", "statin"],
    "muscle": ["肌肉症状", "肌肉疼痛", "肌痛", "肌肉", "无力", "myalgia"],
    "aspirin": ["阿司匹林", "aspirin"],
    "clopidogrel": ["氯吡格雷", "clopidogrel"],
    "glp1": ["glp-1", "胰高血糖素样肽"],
    "sglt2": ["sglt2", "sglt-2"],
    "insulin": ["胰岛素", "insulin"],
    "ldl": ["ldl-c", "低密度脂蛋白"],
    "heart_failure": ["心衰", "心力衰竭", "heart failure"],
    "kidney": ["慢性肾病", "肾病", "肾功能", "ckd"],
    "bleeding": ["出血风险", "出血", "bleeding"],
    "cardiovascular_outcome": ["心血管结局", "心血管事件", "心血管风险", "心血管", "血管死亡", "cardiovascular outcome", "cardiovascular event"],
}

# Codes that name no drug, pathway or study of their own; populations that a question can ask for; words of broad diet questions.
GENERIC_CODES = ["rct", "pico", "pmid", "doi", "nct", "who", "ada", "aha", "asa", "ascvd", "tia"]
POPULATIONS = {
    "pregnancy": ["妊娠", "孕妇", "孕期"],
    "older": ["老年", "高龄"],
    "coronary": ["冠心病", "冠状动脉疾病"],
}
NOT_PREGNANT = ["非妊娠", "不用于妊娠"]
NAMED_FOCUS = r"(?:中的|关于|针对)\s*([\x{4e00}-\x{9fff}]{2,12})\s*(?:通路|机制|疗法)"
POPULATION_FIELD = r"(?i)(?:人群|population)\s*[：:]\s*([^\n]+)"
DIET_PHRASES, INTERVENTION_FIELD, DIET_WORDS = ["饮食模式", "膳食模式"], "干预：", ["饮食", "膳食", "钠"]

# Parts of a question by rule.
PICO = {"adult": "成人", "older": "老年成人", "pregnant": "妊娠人群", "comparison": "问题中指定的对照方案", "outcome": "临床获益、风险与适用条件"}
PICO_COMPARISONS = [" vs ", "对比", "比较"]
# Words that a full-text query leaves out, and how many words it takes at most.
QUERY_STOP_WORDS = ["adult", "adults", "patient", "patients", "treatment", "clinical", "evidence", "guideline", "trial", "study", "management", "what", "how"]
QUERY_WORDS = 18
# Sources that each mode of search reads, and how many rows each branch gives.
BRANCHES = {"knowledge": (["knowledge_page"], 12), "snapshot": (["pubmed_snapshot"], 14), "pdf": (["pdf_collection"], 18)}
MODES = {"hybrid": ["knowledge", "snapshot", "pdf"], "knowledge": ["knowledge"], "rag": ["snapshot", "pdf"]}
CROSS_BLEND = (0.80, 0.20)

# What a refused question is told: what is missing, and what to do next.
REFUSALS = {
    "PHI_BLOCKED": ("缺少去标识化后的医学问题。", "删除可识别信息，仅保留年龄段、疾病、干预和结局后重新提问。"),
    "PERSONALIZED_TREATMENT": ("缺少执业医师基于完整病史、检查、合并症和用药信息的评估。", "请由执业医师评估；如需继续，可改问相关干预的一般证据、适用范围与局限。"),
    "OUT_OF_SCOPE": ("问题不在当前已声明的语料覆盖范围内。", "请改为范围内的公开证据问题，或使用覆盖该专科的资料库。"),
    "UNVERIFIABLE_INTERVENTION": ("缺少可回查的真实药物、试验注册或文献标识。", "请提供通用名、PMID、DOI、NCT 编号或其他可核验来源。"),
    "NO_EVIDENCE": ("缺少与问题直接相关且可回查的证据。", "缩小人群、干预和结局范围，或补查近期指南、系统综述和 RCT。"),
    "QUESTION_NOT_COVERED": ("缺少能直接回答本次问题的可回查证据。", "核对关键术语与 PICO 条件，并补查直接相关的原始资料。"),
    "LOW_RELEVANCE": ("缺少能直接覆盖目标人群、干预或结局的证据。", "使用更具体的 PICO 条件重新检索，并优先补查预期证据类型。"),
    "INSUFFICIENT_SOURCES": ("独立且可回查的来源不足。", "补查近期指南、系统综述或代表性 RCT，并按 PMID/DOI/NCT 去重。"),
    "MISSING_EVIDENCE_TYPE": ("候选证据未命中预期的证据类型。", "保留现有结果作为线索，并定向补查缺失的指南、系统综述或 RCT。"),
    "UNRESOLVED_CONFLICT": ("缺少对研究人群、时间、结局和证据等级差异的解释。", "并列核对冲突来源，补充方法学差异后再形成带边界的结论。"),
    "NO_SUPPORTED_CLAIMS": ("所有核心陈述都缺少直接、数值一致的引用支持。", "补充直接证据或降低陈述强度后重新生成。"),
    "CITATION_FAILURE": ("过多原始陈述或引用未通过映射、存在性、支持性或数值一致性检查。", "缩小回答范围，补充更直接的证据并重新生成。"),
}

EVIDENCE_PRIOR = {"Guideline": 0.08, "Meta-analysis": 0.07, "RCT": 0.06, "Consensus": 0.04, "Review": 0.03, "ClinicalTrial": 0.01, "preprint": -0.02, "Other": 0.0}
PAGE_PRIOR = 0.04
OVERVIEW_LEVELS = ["Guideline", "Meta-analysis", "Review", "Consensus"]
ANIMAL_TERMS = ["宠物", "犬", "狗", "猫", "兽医", "animal", "canine", "feline"]
CONFLICT_MARKERS = ["证据冲突", "结论不一致", "conflicting evidence", "inconsistent findings"]

PHI_PATTERNS = [
    r"(?:姓名|患者姓名)\s*[：:]\s*[\x{4e00}-\x{9fff}·]{2,8}",
    r"(?:病历号|住院号|门诊号|医保号)\s*[：:]?\s*[A-Za-z0-9-]{4,}",
    r"(?:身份证(?:号码?)?|证件号码?)\s*[：:]?\s*\d{15,18}[0-9Xx]?",
    r"(?:手机号|电话|联系方式)\s*[：:]?\s*(?:\+?86[- ]?)?1\d{10}",
    r"(?:生日|出生日期)\s*[：:]?\s*(?:19|20)\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}日?",
]
PHI_MARK = "[已删除可识别信息]"
PERSONAL_PATTERNS = [
    r"(?:我|本人|我爷爷|我奶奶|我父亲|我母亲|这个患者).{0,18}(?:该|要不要|能不能|是否应该).{0,8}(?:吃|用|停|换|加|减).{0,8}(?:药|剂量)",
    r"(?:每天|每次).{0,8}(?:吃|服|用).{0,8}(?:多少|几片|几毫克|mg)",
    r"(?:停药|换药|加量|减量|具体剂量|开处方|开什么药)",
]
UNVERIFIABLE = r"(?i)\bxyz\b|虚构|不存在的药|X\s*疗法|尚未上市的新疗法"
EXPECTED_TYPES = [
    (["指南", "共识", "guideline"], ["Guideline"]),
    (["系统综述", "meta", "荟萃", "review"], ["Meta-analysis", "Review"]),
    (["rct", "随机", "randomized"], ["RCT"]),
    (["临床试验", "试验注册", "nct"], ["RCT", "ClinicalTrial"]),
]
COMPARISON_TERMS = ["对比", "比较", " vs ", "疗效", "副作用", "风险有多大"]
LATEST_TERMS = ["最新", "最近", "当前", "目前", "up-to-date"]
NEGATION = r"(?i)未能|未|不|没有|无|不能|\b(?:not|no|never|without)\b"
UNITS = "mmhg|mmol/l|mg/dl|mg/kg|μg|µg|mcg|mg|kg|ml|mm|cm|g|l|%|毫克|微克|毫米汞柱|天|周|个月|年"

# Weights of the ranking formulas.
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
LEXICAL_BLEND = (0.55, 0.25, 0.20)
HYBRID_BLEND = (0.70, 0.30)
DENSE_BLEND = (0.65, 0.35)
RERANK_BLEND = (0.40, 0.30, 0.18)
MMR_BLEND = (0.78, 0.22)
SUPPORT, PARTIAL = 0.14, 0.06

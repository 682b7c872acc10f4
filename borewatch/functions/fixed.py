"""Lookup tables, word lists and texts that results must reproduce exactly."""

# Field dimension (identifier, block, operator, first and last production year).
FIELDS = [
    ("Volve", 43506, "15/9", "Equinor", 2008, 2016),
    ("Draugen", 43566, "6407/9", "Okea", 1993, None),
    ("Gullfaks", 43718, "34/10", "Equinor", 1986, None),
    ("Oseberg", 43756, "30/6", "Equinor", 1988, None),
]
FIELDS_DDL = "field_name STRING, npdid INT, block STRING, operator STRING, on_stream INT, shut_in INT"

# Published statistics, used where measured ones are absent.
PUBLISHED_STATISTICS = [
    ("Volve", 63000.0, 56200.0, 2010, 42.0, 81.0, 890.0, "2008-2016"),
    ("Draugen", 354000.0, 200000.0, 1995, 63.0, 74.0, 520.0, "1993-present"),
    ("Gullfaks", 2700000.0, 600000.0, 1994, 78.0, 90.0, 760.0, "1986-present"),
    ("Oseberg", 1900000.0, 570000.0, 1991, 65.0, 85.0, 680.0, "1988-present"),
]
PUBLISHED_DDL = (
    "field_name STRING, total_oil_thousand_bbl DOUBLE, peak_oil_bopd DOUBLE, peak_year INT, "
    "avg_water_cut_pct DOUBLE, late_field_water_cut_pct DOUBLE, avg_gor_scf_bbl DOUBLE, production_years STRING"
)

# Source column -> column, field-level monthly file.
FIELD_MONTHLY_COLUMNS = {
    "prfInformationCarrier": "field_name",
    "prfYear": "year",
    "prfMonth": "month",
    "prfPrdOilNetMillSm3": "oil_net_mill_sm3",
    "prfPrdGasNetBillSm3": "gas_net_bill_sm3",
    "prfPrdNGLNetMillSm3": "ngl_net_mill_sm3",
    "prfPrdCondensateNetMillSm3": "condensate_net_mill_sm3",
    "prfPrdOeNetMillSm3": "oe_net_mill_sm3",
    "prfPrdProducedWaterInFieldMillSm3": "produced_water_mill_sm3",
    "prfNpdidInformationCarrier": "npdid_field",
}

# Source column -> column, wellbore-level monthly file.
WELLBORE_MONTHLY_COLUMNS = {
    "wlbNpdidWellbore": "npdid_wellbore",
    "wlbWellboreName": "well_id",
    "prfInformationCarrier": "field_name",
    "prfYear": "year",
    "prfMonth": "month",
    "prfPrdOilNetMillSm3": "oil_net_mill_sm3",
    "prfPrdGasNetBillSm3": "gas_net_bill_sm3",
    "prfPrdNGLNetMillSm3": "ngl_net_mill_sm3",
    "prfPrdWaterNetMillSm3": "water_net_mill_sm3",
    "prfPrdOeNetMillSm3": "oe_net_mill_sm3",
}

# Columns of the daily production file.
DAILY_COLUMNS = [
    "DATEPRD",
    "NPD_WELL_BORE_NAME",
    "NPD_FIELD_NAME",
    "FLOW_KIND",
    "ON_STREAM_HRS",
    "BORE_OIL_VOL",
    "BORE_WAT_VOL",
    "BORE_GAS_VOL",
    "AVG_DOWNHOLE_PRESSURE",
    "AVG_WHP_P",
    "AVG_WHT_P",
    "AVG_CHOKE_SIZE_P",
]

# Path part -> document type.
DOCUMENT_TYPES = {
    "well_reports": "Well Report",
    "maintenance_logs": "Maintenance Log",
    "hse_procedures": "HSE Procedure",
    "equipment_manuals": "Equipment Manual",
    "volve_real": "Volve Open Dataset (production)",
}

# File-name prefix -> folder.
DESTINATIONS = {
    "WR-": "well_reports",
    "EQ-": "equipment_manuals",
    "HSE-": "hse_procedures",
    "ML-": "maintenance_logs",
    "NPD_": "well_reports",
    "Equinor_": "well_reports",
}

# Well-id patterns in order of preference.
WELL_ID_PATTERNS = [
    r"\*\*Well ID:\*\*\s*([\w/\-]+)",
    r"Well ID[:\s]+([\w/\-]+)",
    r"\b(1[45]/\d+-[A-Z]-\d+[A-Z]?)\b",
    r"\b([A-Z]{1,3}-\d+[A-Z]{0,2}H?)\b",
]

# Field names looked for in a text, in order.
FIELD_NAMES = ["Draugen", "Volve", "Gullfaks", "Oseberg"]

# Words without meaning for coverage.
STOPWORDS = (
    "a an the and or but if as at by for from in into of on onto with to too do does did during "
    "how what when where which who whom whose why is are was were be been being "
    "it its this that these those than then there their they them we you your he she his her "
    "not no nor any each every both few more most other some such same so can could should "
    "would will just about over under again further once here all both each few more most "
    "my our your i me mine ours yours yourself yourselves himself herself itself themselves"
).split()
TOKEN_PATTERN = r"[a-z0-9][a-z0-9\-_/]*"

# What reports must hold for questions, overview heuristics and the rerank bonus to find it.
REPORT_METRICS = ("Peak oil BOPD", "Mean oil BOPD", "Mean water cut %", "Peak water cut %", "Mean GOR scf/bbl", "Mean BHP (psi, where reported)")
MONTHS_HEAD = "| Month | Days | Mean oil BOPD | Mean WCT % |\n|-------|-----:|--------------:|-----------:|\n"
WELLS_HEADING = "## Wells represented"

# Patterns of the overview rerank bonus.
WELL_COUNT_PATTERN = r"\*\*\d+\*\*\s+wells?\b"
PEAK_ROW_PATTERN = r"peak\s+oil\s+[0-9,]+(?:\.\d+)?\s*BOPD"

# Words that make a citation an incident.
INCIDENT_WORDS = ["incident", "investigation", "failure", "upset", "anomaly"]

# Instruction-override patterns, matched without regard to case.
INJECTION_PATTERNS = [
    r"ignore\s+(previous|above|all|prior)\s+instructions?",
    r"forget\s+(everything|previous|prior|above)",
    r"disregard\s+(previous|above|prior|all)",
    r"you\s+are\s+now\s+(a|an)\s+",
    r"act\s+as\s+(if\s+)?(you\s+are\s+)?(a|an)\s+",
    r"pretend\s+(to\s+be|you\s+are)",
    r"new\s+(system\s+)?prompt\s*:",
    r"<\s*/?system\s*>",
    r"<\s*/?instruction[s]?\s*>",
    r"\[SYSTEM\]",
    r"\[INST\]",
    r"###\s*(System|Instruction|Override)\s*:",
    r"(print|output|show|reveal|display)\s+(all|your|the\s+system)\s+(prompt|instructions|key|secret)",
    r"(print|show|reveal|output)\s+all\s+of\s+your\s+(instructions?|prompt|keys?|secrets?)",
    r"(print|show|reveal|output)\s+all\s+your\s+(instructions?|prompt|keys?|secrets?)",
    r"what\s+(are|is)\s+your\s+(instructions?|system\s+prompt|directive)",
    r"repeat\s+(everything|all|your\s+(instructions?|prompt))",
    r"(always|never)\s+(recommend|suggest|say|tell\s+the\s+user)",
    r"override\s+(safety|security|confidentiality|hse)",
    r"\bbypass\s+(?:the\s+)?(?:hse|risk\b)",
    r"\bbypass\b.{1,96}?\bescalation\b",
    r"call\s+(tool|function)\s*[:\(]",
    r"execute\s+(command|code|script|shell)",
]

# Operational phrases that never count as attacks.
ALLOWED_PHRASES = [
    "override valve",
    "safety override",
    "bypass valve",
    "bypass line",
    "ignore outliers",
    "disregard noise",
    "act as a reference",
]
ALLOWED_MARK = "__ALLOWLISTED__"
REDACTION = "[REDACTED: potential injection]"

# Words that decide the severity of a scan.
CRITICAL_WORDS = ["ignore previous", "system prompt", "override safety", "bypass"]
REPEAT_WORDS = ["know", "told", "prompt", "instructions", "api keys"]

# Tools each agent may call.
AGENT_TOOLS = {
    "planner": [],
    "executor": [
        "query_timeseries",
        "retrieve_documents",
        "query_similar_incidents",
        "get_well_metadata",
        "get_equipment_status",
    ],
    "critic": [],
    "uncertainty_gate": [],
    "escalation": ["create_escalation", "notify_engineer"],
}

# Tools that need a person's approval.
APPROVAL_TOOLS = [
    "modify_choke",
    "adjust_gaslift_rate",
    "initiate_esd",
    "restart_esp",
    "modify_chemical_injection",
    "notify_psa",
]

# Tools nobody may call.
BLOCKED_TOOLS = ["execute_shell", "write_file", "delete_record", "modify_config", "send_external_email"]

# The four plan steps (description, tool, expected output).
PLAN_STEPS = [
    (
        "Query 72-hour telemetry history for %s to confirm anomaly trend",
        "query_timeseries",
        "Trend data confirming or ruling out anomaly",
    ),
    (
        "Search operational documents for %s maintenance history and well reports",
        "retrieve_documents",
        "Recent maintenance events, known issues, intervention history",
    ),
    (
        "Search for similar %s anomalies in historical incidents",
        "query_similar_incidents",
        "Past incidents with similar signatures and their root causes",
    ),
    (
        "Retrieve HSE procedures relevant to this type of anomaly",
        "retrieve_documents",
        "Safety response requirements and escalation thresholds",
    ),
]

# Causal chains; {feature} marks "baseline -> current" of that feature.
CAUSAL_CHAINS = {
    "water_breakthrough": [
        "1. CAUSE: High water influx from aquifer or injection breakthrough (water_cut {water_cut_pct})",
        "2. MECHANISM: Preferential flow path established via high-permeability zone or fracture",
        "3. EFFECT: Increased surface water handling load → potential separator overload",
        "4. SECONDARY: Reduced relative permeability to oil → oil rate decline expected within 3-7 days",
        "5. ACTION: Log injection-production correlation to confirm WI-producer communication",
    ],
    "gor_spike": [
        "1. CAUSE: Gas coning from gas cap, or separator gas breakthrough",
        "   GOR {gas_oil_ratio} scf/bbl",
        "2. MECHANISM: Vertical gas cone or horizontal gas channel activation",
        "3. EFFECT: Liquid loading risk if GOR exceeds lift capability",
        "4. SECONDARY: Compressor overload possible if sustained — check topside gas handling",
        "5. ACTION: Compare with offset well GOR trend; review choke setting for coning mitigation",
    ],
    "bhp_depletion": [
        "1. CAUSE: Reservoir pressure decline or ESP motor degradation",
        "   BHP {bhp_psi} psi",
        "2. MECHANISM A (reservoir): Depletion without adequate pressure support — check voidage ratio",
        "3. MECHANISM B (equipment): ESP motor wear → reduced pump efficiency → lower BHP",
        "4. EFFECT: Reduced productivity index → oil rate decline",
        "5. ACTION: Run PI test to distinguish reservoir vs. equipment root cause",
    ],
    "oil_rate_collapse": [
        "1. CAUSE: Sudden production stoppage — choke, ESP trip, or surface equipment failure",
        "   Oil rate {oil_rate_bopd} BOPD",
        "2. MECHANISM: Check choke setting, ESP ampere draw, and flowline pressure",
        "3. EFFECT: Immediate revenue loss + well integrity risk if shut-in prolonged",
        "4. SECONDARY: Potential sand/scale deposition during low-flow period",
        "5. ACTION: IMMEDIATE — check ESP status; consider restart protocol",
    ],
    "multi_feature_correlated": [
        "1. CAUSE: Correlated multi-feature anomaly — upstream upset or sensor drift",
        "2. MECHANISM: Check separator inlet conditions; verify sensor calibration dates",
        "3. EFFECT: Uncertain — requires field engineer visual inspection",
        "4. ACTION: URGENT — dispatch field engineer for physical inspection",
    ],
}

# Actions per anomaly type; the first is the primary one.
ACTIONS = {
    "oil_rate_collapse": [
        "Verify ESP status and initiate restart protocol per NORSOK D-010",
        "Check ESP ampere draw for motor condition",
        "Inspect flowline for hydrate plugging",
        "Review choke position — verify not inadvertently closed",
        "Notify production foreman immediately",
    ],
    "bhp_depletion": [
        "Conduct productivity index (PI) test to distinguish reservoir vs. equipment degradation",
        "Review ESP operating point vs. pump curve",
        "Check vibration sensors if available",
        "Evaluate polymer/scale inhibitor squeeze timing",
        "Plan ESP workover if RUL < 30 days",
    ],
    "water_breakthrough": [
        "Investigate water source via injection-production correlation",
        "Pull tracer logs to identify breakthrough interval",
        "Evaluate conformance treatment (polymer flood)",
        "Review water injection rates on connected injectors",
        "Assess surface water handling capacity vs. forecast WOR",
    ],
    "gor_spike": [
        "Adjust choke setting to reduce drawdown and mitigate gas coning",
        "Check separator gas outlet for capacity constraints",
        "Review gas lift mandate if applicable",
        "Model optimum drawdown with reservoir team",
    ],
    "multi_feature_correlated": [
        "Dispatch field engineer for physical inspection and sensor verification",
        "Verify flow meter calibration",
        "Check control valve positioners",
        "Run well test to establish current PI",
    ],
}

# Urgency per anomaly type (bhp_depletion depends on pump life).
URGENCY = {
    "oil_rate_collapse": "IMMEDIATE",
    "water_breakthrough": "URGENT",
    "gor_spike": "PLANNED",
    "thermal_excursion": "URGENT",
    "multi_feature_correlated": "URGENT",
}

# Comparable incidents per anomaly type.
INCIDENTS = {
    "water_breakthrough": [
        "Volve 15/9-F-12: water breakthrough in 2013 — production decline from 10,200 to 6,400 BOPD over 30 days",
        "Draugen D-2H (NPD WR-011): ESP failure due to scale from high-water-cut operation",
        "Industry benchmark: NCS water breakthrough events average 15% oil rate decline within 45 days",
    ],
    "gor_spike": [
        "Volve 15/9-F-14: GOR excursion in 2012 attributed to gas cap coning at high drawdown",
        "Oseberg Gamma: GOR management via choking reduced gas production by 18% while maintaining oil target",
        "Reference: SPE-150523 — Gas coning mitigation in high-GOR Brent-equivalent reservoirs",
    ],
    "bhp_depletion": [
        "Volve historical: BHP decline of 300 psi over 90 days preceded 3 of 4 recorded ESP failures",
        "NCS ESP failure statistics (NPD, 2022): median MTTF = 18 months; BHP decline main precursor",
        "Reference: Takacs (2018) §6.4 — 80% of premature ESP failures show BHP signature 2-6 weeks prior",
    ],
    "oil_rate_collapse": [
        "Volve 15/9-F-11: abrupt rate collapse in 2015 traced to ESP trip on overtemperature",
        "NCS unplanned ESP trips average $2.1M additional cost vs. planned replacement (OTC-28975)",
        "NORSOK D-010 §8.4: requires well integrity verification within 4 hours of unexplained rate collapse",
    ],
}
NO_INCIDENT = "No direct analogue found — manual subsurface review recommended"

# Anomalies injected by the benchmarks (name, kind, feature, factor, rows).
STEP_ANOMALIES = [
    ("water_breakthrough_step", "step", "water_cut_pct", 2.5, 5),
    ("gor_spike_step", "step", "gas_oil_ratio", 3.5, 5),
    ("bhp_depletion_step", "step", "bhp_psi", 0.70, 5),
    ("oil_rate_collapse_step", "step", "oil_rate_bopd", 0.30, 5),
]
RAMP_ANOMALIES = [
    ("water_breakthrough_gradual", "ramp", "water_cut_pct", 1.8, 20),
    ("bhp_depletion_gradual", "ramp", "bhp_psi", 0.80, 20),
]

# Bin edges of the calibration error, as ten equal steps give them in binary.
TENTHS = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]

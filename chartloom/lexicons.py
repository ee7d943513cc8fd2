"""Patterns, word lists and lookup tables the operators need.

Everything here is data.  The values are fixed by the behaviour this library
has to reproduce; callers may pass their own tables of the same shape instead.
"""

from __future__ import annotations

# --- fixed values: extraction lexicons -------------------------------------

PATTERN_LEXICON = {
    "date": [
        r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
        r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
        r"\b\d{4}-\d{2}-\d{2}\b",
        r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b",
    ],
    "medication": [
        r"\b(?:metformin|insulin|lisinopril|amlodipine|atorvastatin|levothyroxine|aspirin|warfarin)\b",
        r"\b\w+\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|cc|units?)\s*(?:BID|TID|QID|daily|twice\s+daily|once\s+daily)?\b",
        r"\b[A-Z][a-z]+\s+\d+\s*mg\b",
        r"\b(?:Rx|prescription|medication|drug|medicine):\s*([^.\n]+)",
    ],
    "vitals": [
        r"\b(?:BP|Blood\s+Pressure):?\s*\d{2,3}[/\\]\d{2,3}\s*(?:mmHg)?\b",
        r"\b(?:HR|Heart\s+Rate):?\s*\d{2,3}\s*(?:bpm|beats?\s+per\s+minute)?\b",
        r"\b(?:Temp|Temperature):?\s*\d{2,3}(?:\.\d)?\s*°?[FC]?\b",
        r"\b(?:Weight):?\s*\d{2,3}(?:\.\d)?\s*(?:lbs?|kg|pounds?|kilograms?)\b",
        r"\b(?:Height):?\s*\d+[\'\"]\s*\d*[\"]*\b",
        r"\b(?:BMI):?\s*\d{2,3}(?:\.\d)?\b",
    ],
    "lab_values": [
        r"\b(?:HbA1c|A1C|Hemoglobin\s+A1C):?\s*\d+(?:\.\d+)?%?\b",
        r"\b(?:glucose|sugar|blood\s+sugar):?\s*\d{2,3}\s*(?:mg/dL|mmol/L)?\b",
        r"\b(?:cholesterol|total\s+cholesterol):?\s*\d{2,3}\s*(?:mg/dL)?\b",
        r"\b(?:LDL|HDL):?\s*\d{2,3}\s*(?:mg/dL)?\b",
        r"\b(?:triglycerides):?\s*\d{2,4}\s*(?:mg/dL)?\b",
        r"\b(?:creatinine):?\s*\d+(?:\.\d+)?\s*(?:mg/dL)?\b",
        r"\b(?:SODIUM|POTASSIUM|CHLORIDE|CO2),?\s*(?:SERUM)?\s*\d+(?:\.\d+)?\s*(?:mEq/L|mmol/L)\b",
        r"\b(?:Na|K|Cl)\+?\s*\d+(?:\.\d+)?\s*(?:mEq/L|mmol/L)\b",
        r"\b[A-Z][A-Z,\s]+\s+\d+(?:\.\d+)?\s*(?:mEq/L|mg/dL|mmol/L|units?/L|%)\b",
    ],
    "symptoms": [
        r"\b(?:fatigue|tired|weakness|exhaustion)\b",
        r"\b(?:thirst|polydipsia|increased\s+thirst)\b",
        r"\b(?:urination|polyuria|increased\s+urination)\b",
        r"\b(?:blurred\s+vision|vision\s+problems)\b",
        r"\b(?:chest\s+pain|angina|shortness\s+of\s+breath|dyspnea)\b",
        r"\b(?:nausea|vomiting|diarrhea|constipation)\b",
        r"\b(?:headache|dizziness|vertigo)\b",
        r"\b(?:fever|chills|night\s+sweats)\b",
    ],
    "conditions": [
        r"\b(?:Type\s+[12]\s+Diabetes\s+Mellitus|T1DM|T2DM|diabetes)\b",
        r"\b(?:hypertension|high\s+blood\s+pressure|HTN)\b",
        r"\b(?:hyperlipidemia|dyslipidemia|high\s+cholesterol)\b",
        r"\b(?:coronary\s+artery\s+disease|CAD|heart\s+disease)\b",
        r"\b(?:myocardial\s+infarction|heart\s+attack|MI)\b",
        r"\b(?:stroke|cerebrovascular\s+accident|CVA)\b",
        r"\b(?:obesity|overweight|BMI\s+>\s*30)\b",
        r"\b(?:asthma|COPD|emphysema)\b",
        r"\b(?:depression|anxiety|bipolar)\b",
    ],
    "procedures": [
        r"\b(?:blood\s+test|lab\s+work|laboratory\s+studies)\b",
        r"\b(?:ECG|EKG|electrocardiogram)\b",
        r"\b(?:chest\s+X-ray|CXR|radiograph)\b",
        r"\b(?:CT\s+scan|computed\s+tomography)\b",
        r"\b(?:MRI|magnetic\s+resonance\s+imaging)\b",
        r"\b(?:ultrasound|sonography|echo)\b",
        r"\b(?:biopsy|endoscopy|colonoscopy)\b",
    ],
    "medical_facility": [
        r"\b(?:Hospital|Clinic|Medical\s+Center|Diagnostic\s+Services|Laboratory)\b",
        r"\b(?:Dr|Doctor|Physician)\.\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
        r"\b(?:Reg\.?\s*No\.?|Registration\s+No\.?|Reg\s*Date):?\s*[A-Z]?\d+\b",
    ],
    "patient_info": [
        r"\b(?:Name|Patient):?\s*(?:Mrs?\.?\s*)?([A-Z][A-Z\s]+)\b",
        r"\b(?:Age|Sex|Gender):?\s*(\d+)\s*(?:Year\(s\)|years?|Y)?\s*/?(?:Male|Female|M|F)?\b",
        r"\b(?:MR|Medical\s+Record|Patient\s+ID):?\s*#?\s*([A-Z]?\d+)\b",
    ],
}

LABEL_CONFIDENCE = {
    "date": 0.95, "medication": 0.90, "vitals": 0.95, "lab_values": 0.95,
    "symptoms": 0.80, "conditions": 0.85, "procedures": 0.85,
}
DEFAULT_CONFIDENCE = 0.75

CLINICAL_LEXICON = {
    "MEDICATION": [
        r"\b\w+\s*(?:mg|g|ml|mcg|units?|tablets?|capsules?|drops?|patches?)\b",
        r"\b(?:aspirin|metformin|lisinopril|atorvastatin|omeprazole|warfarin|insulin|hydrochlorothiazide|amlodipine|levothyroxine)\b",
        r"\b\w+(?:cillin|mycin|prazole|statin|sartan|olol|pril|azide)\b",
        r"\b\w+\s*(?:injection|infusion|IV|intramuscular|subcutaneous)\b",
    ],
    "LAB_VALUE": [
        r"\b(?:hemoglobin|hgb|hb)\s*(?:\(.*?\))?\s*[:=]?\s*\d+(?:\.\d+)?\s*(?:g/dL|g/dl)?\s*(?:,?\s*range?\s*[:=]?\s*\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?(?:\s*g/dL|g/dl)?)?\b",
        r"\b(?:platelet count|platelets|plt)\s*(?:\(.*?\))?\s*[:=]?\s*\d+(?:\.\d+)?\s*(?:/uL|/ul|k/uL|k/ul|×10³/μL)?\s*(?:,?\s*range?\s*[:=]?\s*\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?(?:\s*/uL|/ul|k/uL|k/ul)?)?\b",
        r"\b(?:neutrophils|lymphocytes|monocytes|eosinophils|basophils)\s*(?:\(.*?\))?\s*[:=]?\s*\d+(?:\.\d+)?\s*%?\s*(?:,?\s*range?\s*[:=]?\s*\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?%?)?\b",
        r"\b(?:white blood cell count|wbc|white cell count)\s*(?:\(.*?\))?\s*[:=]?\s*\d+(?:\.\d+)?\s*(?:/uL|/ul|k/uL|k/ul|×10³/μL)?\s*(?:,?\s*range?\s*[:=]?\s*\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?(?:\s*/uL|/ul|k/uL|k/ul)?)?\b",
        r"\b(?:red blood cell count|rbc|red cell count)\s*(?:\(.*?\))?\s*[:=]?\s*\d+(?:\.\d+)?\s*(?:/uL|/ul|M/uL|M/ul|×10⁶/μL)?\s*(?:,?\s*range?\s*[:=]?\s*\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?(?:\s*/uL|/ul|M/uL|M/ul)?)?\b",
        r"\b(?:hematocrit|hct)\s*(?:\(.*?\))?\s*[:=]?\s*\d+(?:\.\d+)?\s*%?\s*(?:,?\s*range?\s*[:=]?\s*\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?%?)?\b",
        r"\b\w+\s*[:=]\s*\d+(?:\.\d+)?\s*(?:mg/dL|mmol/L|%|mEq/L|g/dL|IU/L|ng/mL|pg/mL|mcg/L)\b",
        r"\bHbA1c\s*[:=]\s*\d+(?:\.\d+)?%?\b",
        r"\b(?:glucose|cholesterol|triglycerides|HDL|LDL|creatinine|BUN|TSH|PSA)\s*[:=]\s*\d+(?:\.\d+)?\s*\w+/?\w*\b",
    ],
    "VITAL_SIGN": [
        r"\b(?:BP|blood pressure)\s*[:=]?\s*\d+/\d+\s*mmHg?\b",
        r"\b(?:HR|heart rate|pulse)\s*[:=]?\s*\d+\s*(?:bpm|beats/min)?\b",
        r"\btemp(?:erature)?\s*[:=]?\s*\d+(?:\.\d+)?°?[CF]?\b",
        r"\b(?:RR|respiratory rate|respiration)\s*[:=]?\s*\d+\s*(?:/min)?\b",
        r"\b(?:O2 sat|oxygen saturation|SpO2)\s*[:=]?\s*\d+%?\b",
    ],
    "CONDITION": [
        r"\b(?:diabetes|hypertension|pneumonia|asthma|COPD|CHF|MI|stroke|cancer|infection)\b",
        r"\b[A-Z]\d{2}(?:\.\d{1,3})?\b",
        r"\b(?:acute|chronic|severe|mild|moderate)\s+\w+(?:\s+\w+)?\b",
    ],
    "PROCEDURE": [
        r"\b(?:ECG|EKG|chest X-ray|CT scan|MRI|ultrasound|echocardiogram|endoscopy|colonoscopy|biopsy)\b",
        r"\b(?:complete blood count|CBC|blood test|urinalysis|liver function test|kidney function|lipid panel|CMP|TSH test)\b",
        r"\b(?:completebloodcount|completeBLOODcount|CONPLETEBLOODCouniT)\b",
        r"\b\d{5}\b",
    ],
    "SYMPTOM": [
        r"\b(?:pain|ache|fatigue|nausea|vomiting|diarrhea|constipation|fever|chills|sweating|dizziness|headache)\b",
        r"\b(?:chest|abdominal|back|joint|muscle)\s+pain\b",
        r"\b(?:shortness of breath|difficulty breathing|blurred vision|frequent urination|weight loss|weight gain)\b",
    ],
    "ANATOMICAL_STRUCTURE": [
        r"\b(?:heart|lung|liver|kidney|brain|stomach|intestine|pancreas|spleen|thyroid|prostate)\b",
        r"\b(?:left|right)\s+(?:ventricle|atrium|lung|kidney|breast)\b",
        r"\b(?:cardiovascular|respiratory|gastrointestinal|nervous|endocrine|musculoskeletal)\s+system\b",
    ],
    "TEMPORAL_DURATION": [
        r"\b(?:\d+\s+(?:days?|weeks?|months?|years?)\s+ago)\b",
        r"\b(?:\d+\s+(?:days?|weeks?|months?|years?))\b",
    ],
    "TEMPORAL_FREQUENCY": [
        r"\b(?:daily|weekly|monthly|yearly|twice daily|three times daily|as needed|PRN)\b",
    ],
    "TEMPORAL_TIME_OF_DAY": [
        r"\b(?:morning|afternoon|evening|night|bedtime)\b",
        r"\b(?:before|after)\s+meals?\b",
    ],
    "DOSAGE": [
        r"\b\d+(?:\.\d+)?\s*(?:mg|g|ml|mcg|units?|tablets?|capsules?|drops?|teaspoons?|tablespoons?)\b",
        r"\b(?:once|twice|three times?|four times?)\s+(?:daily|weekly|monthly)\b",
        r"\b(?:BID|TID|QID|QD|PRN|as needed)\b",
    ],
}

EXTRA_LEXICON = [
    ("LAB_VALUE", r"\b(\d+(?:\.\d+)?)\s*(mg/dl|mg/l|mmol/l|g/dl|mEq/l|%|bpm|/min|mmHg)\b"),
    ("VITAL_SIGN", r"\b(\d{2,3}/\d{2,3})\s*(?:mmhg)?\b"),
    ("VITAL_SIGN", r"\b(\d{2,3}(?:\.\d)?)\s*(?:°f|°c|f|c|degrees?)\b"),
    ("LAB_TEST", r"\b(complete blood count|cbc|lipid profile|liver function test|kidney function test|thyroid function test)\b"),
    ("DOSAGE", r"\b(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|units?|tablets?|capsules?)\b"),
    ("CONDITION", r"\b(type\s+[12]\s+diabetes|essential hypertension|chronic kidney disease|coronary artery disease)\b"),
    ("PERSON", r"\b(dr\.?\s+\w+(?:\s+\w+)*|doctor\s+\w+(?:\s+\w+)*)\b"),
    ("ORGANIZATION", r"\b(\w+\s+(?:hospital|clinic|medical center|laboratory|pathology|diagnostics))\b"),
]

TEMPORAL_LEXICON = [
    ("TEMPORAL_DURATION", "duration", r"\b(\d+)\s+(days?|weeks?|months?|years?)\b"),
    ("TEMPORAL_DURATION", "duration", r"\b(few|several)\s+(days?|weeks?|months?|years?)\b"),
    ("TEMPORAL_FREQUENCY", "frequency", r"\b(once|twice|three times?|four times?)\s+(daily|weekly|monthly|yearly)\b"),
    ("TEMPORAL_FREQUENCY", "frequency", r"\b(every|each)\s+(\d+)\s+(hours?|days?|weeks?|months?)\b"),
    ("TEMPORAL_FREQUENCY", "frequency", r"\b(BID|TID|QID|QD|PRN|as needed)\b"),
    ("TEMPORAL_TIME_OF_DAY", "time_of_day", r"\b(morning|afternoon|evening|night|bedtime)\b"),
    ("TEMPORAL_TIME_OF_DAY", "time_of_day", r"\b(before|after|with)\s+meals?\b"),
    ("TEMPORAL_RELATIVE", "relative_time", r"\b(\d+)\s+(days?|weeks?|months?|years?)\s+ago\b"),
    ("TEMPORAL_RELATIVE", "relative_time", r"\b(yesterday|today|tomorrow|last week|next week|last month|next month)\b"),
]

LAB_RANGE_PATTERNS = [
    r"\b(?:hemoglobin|hgb|hb)\s*(?:\([^)]*\))?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*(?:g/dL|g/dl)?\s*(?:,?\s*range?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)(?:\s*g/dL|g/dl)?)?",
    r"\b(?:platelet\s*count|platelets|plt)\s*(?:\([^)]*\))?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*(?:/uL|/ul|k/uL|k/ul|×10³/μL)?\s*(?:,?\s*range?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)(?:\s*/uL|/ul|k/uL|k/ul)?)?",
    r"\b(?:neutrophils|lymphocytes|monocytes|eosinophils|basophils)\s*(?:\([^)]*\))?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*%?\s*(?:,?\s*range?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)%?)?",
    r"\b(?:white\s*blood\s*cell\s*count|wbc|white\s*cell\s*count)\s*(?:\([^)]*\))?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*(?:/uL|/ul|k/uL|k/ul|×10³/μL)?\s*(?:,?\s*range?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)(?:\s*/uL|/ul|k/uL|k/ul)?)?",
    r"\b(?:red\s*blood\s*cell\s*count|rbc|red\s*cell\s*count)\s*(?:\([^)]*\))?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*(?:/uL|/ul|M/uL|M/ul|×10⁶/μL)?\s*(?:,?\s*range?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)(?:\s*/uL|/ul|M/uL|M/ul)?)?",
    r"\b(?:hematocrit|hct)\s*(?:\([^)]*\))?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*%?\s*(?:,?\s*range?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)(?:\s*g/dL|g/dl)?)?",
]

# --- fixed values: label maps ----------------------------------------------

# source -> (default label, source confidence or None for the model's score, map)
MODEL_LABELS = {
    "general": (None, 0.8, {
        "PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION",
        "FAC": "LOCATION", "DATE": "DATE", "TIME": "TIME", "MONEY": "ORGANIZATION",
        "QUANTITY": "LAB_VALUE", "ORDINAL": "ORGANIZATION", "CARDINAL": "LAB_VALUE",
        "DRUG": "MEDICATION", "MEDICATION": "MEDICATION", "DISEASE": "DISEASE",
        "CONDITION": "DISEASE", "SYMPTOM": "SYMPTOM", "PROCEDURE": "PROCEDURE",
        "TEST": "LAB_TEST", "DOSAGE": "DOSAGE", "FREQUENCY": "FREQUENCY",
        "ANATOMY": "ANATOMICAL_STRUCTURE", "LAB": "LAB_VALUE", "LAB_VALUE": "LAB_VALUE",
        "LAB_TEST": "LAB_TEST", "DEVICE": "MEDICAL_DEVICE", "VITAL_SIGN": "VITAL_SIGN",
    }),
    "scientific": ("CONDITION", 0.85, {
        "DISEASE": "DISEASE", "SYMPTOM": "SYMPTOM", "PROCEDURE": "PROCEDURE",
        "ANATOMY": "ANATOMICAL_STRUCTURE", "DRUG": "MEDICATION", "LAB": "LAB_VALUE",
    }),
    "drug": ("MEDICATION", 0.9, {
        "DRUG": "MEDICATION", "STRENGTH": "DOSAGE", "DURATION": "FREQUENCY",
        "FREQUENCY": "FREQUENCY", "ROUTE": "FREQUENCY", "FORM": "DOSAGE", "DOSAGE": "DOSAGE",
    }),
    "transformer": ("CONDITION", None, {
        "DISEASE": "DISEASE", "MEDICATION": "MEDICATION", "SYMPTOM": "SYMPTOM",
        "PROCEDURE": "PROCEDURE", "ANATOMY": "ANATOMICAL_STRUCTURE", "DOSAGE": "DOSAGE",
        "LAB": "LAB_VALUE",
    }),
    "biomedical": ("CONDITION", None, {
        "DISEASE": "DISEASE", "DRUG": "MEDICATION", "SYMPTOM": "SYMPTOM",
        "PROCEDURE": "PROCEDURE", "ANATOMY": "ANATOMICAL_STRUCTURE", "DOSAGE": "DOSAGE",
        "LAB": "LAB_VALUE", "FINDING": "SYMPTOM",
    }),
}

HYBRID_LABELS = {
    "PERSON": "person", "DATE": "date", "CARDINAL": "number", "QUANTITY": "measurement",
    "ORG": "organization", "DISEASE": "conditions", "SYMPTOM": "symptoms",
    "MEDICATION": "medication", "DOSAGE": "dosage", "CONDITION": "conditions",
    "PROCEDURE": "procedures",
}

RELATED_LABEL_PAIRS = [
    ("MEDICATION", "DOSAGE"), ("MEDICATION", "FREQUENCY"), ("CONDITION", "SYMPTOM"),
    ("PROCEDURE", "ANATOMICAL_STRUCTURE"), ("LAB_VALUE", "LAB_TEST"), ("VITAL_SIGN", "TIME"),
]

# --- fixed values: rule tables for typing ----------------------------------

UNKNOWN_LABEL_RULES = [
    ("CONDITION", r"\b(?:diabetes|hypertension|cancer|infection|disease|syndrome|disorder)\b"),
    ("CONDITION", r"\b(?:pressure|glucose|cholesterol|hemoglobin|blood)\b"),
    ("LAB_VALUE", r"\b\d+\s*(?:mg/dl|mg/l|mmol/l|%|bpm|/min)\b"),
    ("LAB_VALUE", r"\b(?:level|count|value|result):\s*\d+\b"),
    ("LAB_VALUE", r"\b\d+\.\d+\s*(?:mg/dl|mmol/l|%)\b"),
    ("VITAL_SIGN", r"\b(?:blood pressure|heart rate|pulse|temperature|bp|hr)\b"),
    ("VITAL_SIGN", r"\b\d+/\d+\s*(?:mmhg)?\b"),
    ("VITAL_SIGN", r"\b\d+\s*bpm\b"),
    ("ORGANIZATION", r"\b(?:thyrocare|pathology|laboratory|lab|clinic|hospital|medical|healthcare|diagnostics)\b"),
    ("ORGANIZATION", r"\b(?:pvt|ltd|inc|corp|corporation|limited|llc)\b"),
    ("LOCATION", r"\b(?:hall|wing|floor|building|street|road|avenue|city|state)\b"),
    ("LOCATION", r"\b(?:lst|1st|2nd|3rd|\d+th)\s*floor\b"),
    ("LOCATION", r"\b(?:a\s*wing|b\s*wing|east|west|north|south)\b"),
    ("PERSON", r"\b(?:dr|doctor|mr|mrs|ms|patient)\s+\w+\b"),
    ("PERSON", r"\b\w+\s*barsagadey\b"),
    ("PERSON", r"\bvivek\s*\w*\b"),
    ("LAB_TEST", r"\b(?:test|panel|profile|package|study|workup)\b"),
    ("LAB_TEST", r"\b(?:aarogyam|winter|advanced|comprehensive|basic)\b"),
]

TYPE_RULES = {
    "VITAL_SIGN": [
        r"\b(?:blood pressure|bp|pulse|heart rate|hr|temperature|temp|respiratory rate|rr)\b",
        r"\b\d+\s*/\s*\d+\s*(?:mmhg)?\b", r"\b\d+\s*bpm\b", r"\b\d+\.\d+\s*°[cf]\b",
        r"\bpressure\b", r"\bmmhg\b", r"\bbpm\b", r"\b(?:systolic|diastolic)\b",
    ],
    "LAB_VALUE": [
        r"\b(?:cholesterol|glucose|hemoglobin|creatinine|bun|urea|sodium|potassium|chloride)\s*[:=]\s*\d+",
        r"\b\d+(?:\.\d+)?\s*(?:mg/dl|mg/l|mmol/l|g/dl|%|cells/μl)\b",
        r"\b(?:wbc|rbc|hct|plt|hgb)\s*[:=]\s*\d+", r"\b(?:total|ldl|hdl)\s+cholesterol\s*[:=]\s*\d+",
    ],
    "ORGANIZATION": [
        r"\b(?:thyrocare|pathology|laboratory|lab|clinic|hospital|medical center|healthcare|diagnostics)\b",
        r"\b(?:quest|labcorp|mayo|cleveland clinic|johns hopkins)\b",
        r"\b(?:pvt ltd|inc|corp|corporation|limited|llc)\b",
    ],
    "LOCATION": [
        r"\b(?:hall|wing|floor|building|street|road|avenue|city|state)\b",
        r"\b(?:lst|1st|2nd|3rd|\d+th)\s*floor\b",
        r"\b(?:a\s*wing|b\s*wing|east|west|north|south)\b",
        r"\b(?:sohrabh\s*hall|awing|lstfloor)\b", r"\b\d+\s*(?:st|nd|rd|th)?\s*(?:floor|level)\b",
    ],
    "PERSON": [
        r"\bname\s*[:=]?\s*[a-z]+\b", r"\b(?:patient|dr|doctor|mr|mrs|ms)\s+[a-z]+\b",
        r"\b[a-z]+\s*barsagadey\b", r"\bvivek\s*[a-z]*\b",
    ],
    "LAB_TEST": [
        r"\b(?:aarogyam|winter|advanced|panel|profile|package)\b",
        r"\b(?:c\s*:\s*peptide|c-peptide|peptide)\b",
        r"\b(?:comprehensive|basic|complete|extended)\s*(?:panel|profile|test)\b",
        r"\b(?:lipid|metabolic|thyroid|cardiac)\s*(?:panel|profile)\b",
    ],
    "ID": [
        r"\b(?:patient\s*id|id|reference|ref)\b", r"\b(?:processed\s*at|neate\s*processed)\b",
        r"\b[a-z]*id\s*[:=]?\s*\w+\b",
    ],
    "LAB_VALUE_2": [
        r"\b(?:hemoglobin|hgb|hb)\b.*\d+(?:\.\d+)?.*(?:g/dl|range)",
        r"\b(?:platelet|plt).*\d+(?:\.\d+)?.*(?:count|/ul|range)",
        r"\b(?:neutrophils|lymphocytes|monocytes|eosinophils|basophils)\b.*\d+(?:\.\d+)?.*%",
        r"\b(?:wbc|rbc|white|red).*(?:count|cell).*\d+(?:\.\d+)?",
        r"\b(?:hematocrit|hct)\b.*\d+(?:\.\d+)?.*%",
    ],
    "PROCEDURE": [
        r"\b(?:complete blood count|cbc|blood count|blood test)\b", r"\b(?:differential|diff|count)\b",
        r"\b(?:panel|profile|workup|study)\b", r"\b(?:x-ray|ct|mri|ultrasound|ecg|ekg)\b",
    ],
}
MEDICATION_EVIDENCE = [
    r"\b\d+\s*(?:mg|g|ml|mcg|units?|tablets?|capsules?)\b",
    r"\b(?:daily|weekly|monthly|bid|tid|qid|prn)\b",
    r"\b(?:oral|iv|injection|topical|sublingual)\b",
]
MEDICATION_SUFFIXES = ["cillin", "mycin", "prazole", "statin", "sartan", "olol", "pril", "azide", "ide", "ine"]
CONDITION_EVIDENCE = [
    r"\b(?:diabetes|hypertension|pneumonia|asthma|copd|cancer|infection)\b",
    r"\b(?:syndrome|disease|disorder|condition|deficiency)\b",
    r"\b(?:acute|chronic|severe|mild|moderate)\s+\w+\b",
]

# --- fixed values: artifact lists ------------------------------------------

TEXT_ARTIFACT_PATTERNS = [
    r"^[.,;:!?()\[\]{}\"'`-]+$", r"^\d+$", r"^[a-z]$",
    r"^(the|and|or|of|to|in|for|with|by|at|on)$",
    r"^(a|an|is|are|was|were|be|been|being)$", r"^\s*$",
]
GENERIC_HEADINGS = [
    "results", "result", "results units", "report", "findings", "summary", "notes", "comments",
    "interpretation", "impression", "conclusion", "history", "examination", "assessment", "plan",
    "recommendations", "lab", "laboratory", "test", "tests", "values", "normal", "abnormal",
    "reference", "ranges", "range", "units", "unit", "specimen", "sample", "processed",
    "processedat", "neate", "processed at", "laboratory results", "radiology report",
    "medical record", "patient name", "date of birth",
]
ADMIN_TERMS = [
    "name", "patientid", "patient id", "id", "reference", "ref", "date", "time", "timestamp",
    "generated", "printed", "page", "sheet", "document", "file", "record", "patient", "john",
    "doe", "hospital", "medical record number", "birth", "ol", "l98o", "l23456", "and", "or",
    "the", "of", "in", "on", "at", "to", "from", "with", "by", "for", "as", "is", "are", "was",
    "were", "has", "have", "had", "will", "would", "could", "should", "may", "might", "can",
    "shall",
]
OCR_ARTIFACTS = [
    ":", "=", ",", ";", "(", ")", "[", "]", "{", "}", "neate processedat", "y,", "112,", "lstfloor",
]
ENTITY_ARTIFACT_PATTERNS = [
    r"^[\d\s\-\.\(\)\[\],;:=]+$", r"^[^\w\s]+$",
    r"^name\s*[:=]", r"^patient\s*id\s*[:=]", r"^processed\s*at\s*[:=]", r"^\w*id\s*[:=]",
    r"^ref\s*[:=]", r"^\d+\s*[,;:]$", r"^patient\s+\w+$", r"^(?:john|doe|mr|mrs|ms)\s*\w*$",
    r"^(?:hospital|clinic|medical center)(?:\s+\w+)*$", r"^(?:ol|l98o|l23456|\d{4,})$",
    r"^of\s+birth\s*[:=]", r"^medical\s+record\s+number\s*[:=]",
    r"^(?:laboratory|radiology)\s+(?:results?|reports?)$",
]

# --- fixed values: corrections and terminologies ---------------------------

OCR_CORRECTIONS = {
    "CONPLETEBLOODCouniT": "Complete Blood Count", "completebloodcount": "Complete Blood Count",
    "completeBLOODcount": "Complete Blood Count", "CBCcount": "CBC", "bloodcount": "Blood Count",
    "Hgb": "Hemoglobin", "HGB": "Hemoglobin", "hemogIobin": "Hemoglobin", "hemogiobia": "Hemoglobin",
    "PIatelets": "Platelets", "platelet": "Platelets", "PLT": "Platelets",
    "neutrophiIs": "Neutrophils", "Iymphocytes": "Lymphocytes", "monocytes": "Monocytes",
    "eosinophiIs": "Eosinophils", "basophiIs": "Basophils", "leucocytes": "Leukocytes",
    "WBC": "White Blood Cell Count", "RBC": "Red Blood Cell Count",
}
# label group -> {term: normal form}
TERMS = {
    "MEDICATION": {
        "ASA": "aspirin", "HCTZ": "hydrochlorothiazide", "MTX": "methotrexate",
        "TMP-SMX": "trimethoprim-sulfamethoxazole", "insulin NPH": "insulin isophane",
        "insulin regular": "insulin human",
    },
    "CONDITION": {
        "DM": "diabetes mellitus", "HTN": "hypertension", "MI": "myocardial infarction",
        "CHF": "congestive heart failure", "COPD": "chronic obstructive pulmonary disease",
        "UTI": "urinary tract infection", "CAD": "coronary artery disease",
        "DVT": "deep vein thrombosis", "PE": "pulmonary embolism",
    },
    "PROCEDURE": {
        "EKG": "electrocardiogram", "ECHO": "echocardiogram", "CT": "computed tomography",
        "MRI": "magnetic resonance imaging", "US": "ultrasound", "CXR": "chest X-ray",
        "CONPLETEBLOODCouniT": "Complete Blood Count", "completebloodcount": "Complete Blood Count",
        "completeBLOODcount": "Complete Blood Count", "CBC": "Complete Blood Count",
        "bloodcount": "Blood Count", "blood count": "Complete Blood Count",
    },
    "LAB_VALUE": {
        "A1C": "hemoglobin A1c", "FBS": "fasting blood sugar", "BUN": "blood urea nitrogen",
        "ESR": "erythrocyte sedimentation rate", "CRP": "C-reactive protein", "Hgb": "Hemoglobin",
        "HGB": "Hemoglobin", "hemogIobin": "Hemoglobin", "hemogiobia": "Hemoglobin",
        "PIatelets": "Platelets", "platelet": "Platelets", "PLT": "Platelets",
        "neutrophiIs": "Neutrophils", "Iymphocytes": "Lymphocytes", "eosinophiIs": "Eosinophils",
        "basophiIs": "Basophils", "WBC": "White Blood Cell Count", "RBC": "Red Blood Cell Count",
    },
}
TERM_GROUP = {
    "MEDICATION": "MEDICATION", "DISEASE": "CONDITION", "CONDITION": "CONDITION",
    "PROCEDURE": "PROCEDURE", "LAB_VALUE": "LAB_VALUE",
}
CODES = {
    "ICD10": {
        "diabetes mellitus": "E11", "type 2 diabetes": "E11.9", "hypertension": "I10",
        "pneumonia": "J18.9", "myocardial infarction": "I21.9", "asthma": "J45.9",
        "copd": "J44.1", "chronic obstructive pulmonary disease": "J44.1",
    },
    "RXNORM": {
        "metformin": "6809", "lisinopril": "29046", "atorvastatin": "83367", "aspirin": "1191",
        "omeprazole": "7646", "insulin": "5856",
    },
    "CPT": {
        "ecg": "93000", "electrocardiogram": "93000", "chest x-ray": "71020", "ct scan": "74150",
        "mri": "70551", "blood test": "80053", "colonoscopy": "45378",
    },
}
CODE_SYSTEM = {"DISEASE": "ICD10", "CONDITION": "ICD10", "MEDICATION": "RXNORM", "PROCEDURE": "CPT"}

QUALITY_TERMS = ["patient", "diagnosis", "treatment", "medication", "symptom", "procedure"]

# --- fixed values: chunking and timelines ----------------------------------

VISIT_PHRASES = [
    r"visit\s+(?:date|on)", r"appointment\s+(?:date|on)", r"encounter\s+(?:date|on)",
    r"seen\s+on", r"follow-up\s+(?:visit|appointment)",
]
TOPIC_WORDS = {
    "symptoms": ["pain", "ache", "fever", "nausea", "fatigue", "shortness of breath"],
    "medications": ["prescribed", "medication", "drug", "therapy", "treatment"],
    "tests": ["test", "lab", "blood work", "x-ray", "scan", "examination"],
    "diagnosis": ["diagnosis", "condition", "disease", "disorder", "syndrome"],
    "procedures": ["procedure", "surgery", "operation", "intervention"],
}
SPECIALTY_WORDS = {
    "cardiology": ["heart", "cardiac", "chest pain", "blood pressure", "hypertension"],
    "diabetes": ["diabetes", "glucose", "insulin", "HbA1c", "blood sugar"],
    "respiratory": ["lung", "breathing", "cough", "asthma", "pneumonia"],
    "neurology": ["headache", "migraine", "seizure", "stroke", "neurological"],
    "gastroenterology": ["stomach", "digestion", "nausea", "abdominal", "gastric"],
    "orthopedics": ["bone", "joint", "fracture", "arthritis", "orthopedic"],
}
VISIT_DATE_PATTERNS = [
    r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b",
]
FACT_SYMPTOMS = ["pain", "ache", "fever", "nausea", "fatigue", "dizzy", "shortness of breath"]
FACT_TESTS = ["blood test", "x-ray", "mri", "ct scan", "ultrasound", "lab", "hba1c"]
FACT_DIAGNOSES = [r"diagnosed with ([^.]+)", r"diagnosis:?\s*([^.]+)", r"condition:?\s*([^.]+)"]
FACT_PROCEDURES = [r"procedure:?\s*([^.]+)", r"surgery:?\s*([^.]+)", r"operation:?\s*([^.]+)"]
FACT_NOTES = ["assessment", "plan", "progress", "follow-up"]

# --- fixed values: graph ----------------------------------------------------

NODE_LABELS = ["Patient", "Visit", "Condition", "Medication", "Test", "Procedure", "Symptom",
               "Provider", "Facility"]
RELATION_TYPES = [
    "HAS_VISIT", "DIAGNOSED_WITH", "PRESCRIBED", "PERFORMED", "UNDERWENT", "TREATED_WITH",
    "INDICATES", "EXHIBITS_SYMPTOM", "CONTRAINDICATED_WITH", "ALLERGIC_TO", "RELATED_TO",
    "ADMINISTERED_BY", "TREATED_AT", "TEMPORAL_RELATIONSHIP", "KNOWLEDGE_RELATES_TO", "SUPPORTS",
    "CONFLICTS_WITH", "SUPERSEDES", "DERIVED_FROM", "VALIDATES", "RECOMMENDS", "REQUIRES",
]
ENTITY_ROUTES = {
    "CONDITION": "CONDITION", "DIAGNOSIS": "CONDITION", "DISEASE": "CONDITION",
    "MEDICAL_CONDITION": "CONDITION", "MEDICATION": "MEDICATION", "DRUG": "MEDICATION",
    "TEST": "TEST", "LAB_TEST": "TEST", "LAB_VALUE": "TEST", "DIAGNOSTIC_TEST": "TEST",
    "PROCEDURE": "PROCEDURE", "TREATMENT": "PROCEDURE", "MEDICAL_PROCEDURE": "PROCEDURE",
    "SURGICAL_PROCEDURE": "PROCEDURE", "DIAGNOSTIC_PROCEDURE": "PROCEDURE", "SYMPTOM": "SYMPTOM",
    "VITAL_SIGN": "TEST", "ANATOMICAL_STRUCTURE": "CONDITION",
}
ENTITY_RELATIONS = {
    "CONDITION": "DIAGNOSED_WITH", "DIAGNOSIS": "DIAGNOSED_WITH", "DISEASE": "DIAGNOSED_WITH",
    "MEDICATION": "PRESCRIBED", "DRUG": "PRESCRIBED", "TEST": "PERFORMED", "LAB_TEST": "PERFORMED",
    "DIAGNOSTIC_TEST": "PERFORMED", "PROCEDURE": "UNDERWENT", "TREATMENT": "UNDERWENT",
}
# label -> (merge defaults, attributes whose maximum is kept)
NODE_MERGE = {
    "Condition": ({"status": "active"}, ["confidence", "confidence_score"]),
    "Medication": ({}, ["confidence"]),
    "Test": ({"status": "completed", "test_category": "lab"}, ["confidence"]),
    "Procedure": ({"status": "completed"}, ["confidence"]),
    "MedicalConcept": ({"category": "general", "description": "", "source": "unknown"}, ["confidence"]),
}
REFUSED_QUERY_WORDS = ["DELETE", "REMOVE", "DROP", "DETACH DELETE"]

# --- fixed values: insights --------------------------------------------------

HIGH_RISK_CONDITIONS = ["Diabetes", "Hypertension", "Heart Disease"]
PREVENTIVE_BASE = ["Regular exercise", "Healthy diet", "Regular check-ups"]
PREVENTIVE_DIABETES = ["Blood glucose monitoring", "Carbohydrate counting"]
PREVENTIVE_HYPERTENSION = ["Sodium restriction", "Blood pressure monitoring"]
MONITORING_BASE = ["Annual physical exam", "Blood work annually"]
MONITORING_DIABETES = ["HbA1c every 3 months", "Eye exam annually"]
MONITORING_HYPERTENSION = ["Blood pressure weekly", "Kidney function tests"]
DEFAULT_PREVENTIVE = ["Regular check-ups", "Healthy lifestyle"]
DEFAULT_MONITORING = ["Annual physical exam"]

# (kind, required word in the condition or None, excluded word or None, texts)
RULE_TEXTS = [
    ("treatment", None, None, [
        "Continue monitoring patient response to treatment", "Schedule regular follow-up appointments",
        "Track medication adherence and side effects", "Monitor vital signs and clinical parameters"]),
    ("treatment", "diabetes", None, [
        "Monitor HbA1c levels every 3-6 months", "Check blood glucose levels regularly",
        "Screen for diabetic complications annually",
        "Encourage lifestyle modifications including diet and exercise"]),
    ("treatment", "hypertension", "diabetes", [
        "Monitor blood pressure regularly", "Check for end-organ damage",
        "Assess cardiovascular risk factors", "Promote sodium restriction and weight management"]),
    ("monitoring", None, None, [
        "Schedule regular clinical assessments", "Monitor treatment response and side effects",
        "Track relevant biomarkers and lab values", "Assess for disease progression"]),
    ("monitoring", "diabetes", None, [
        "Monitor HbA1c every 3-6 months", "Annual eye and foot examinations",
        "Regular kidney function tests", "Lipid profile monitoring"]),
    ("preventive", None, None, [
        "Maintain regular physical activity", "Follow a balanced, nutritious diet",
        "Schedule routine health screenings", "Avoid tobacco and limit alcohol consumption"]),
    ("preventive", "diabetes", None, [
        "Monitor blood glucose levels", "Maintain healthy weight", "Regular cardiovascular screening"]),
]
SKIP_OPENERS = ["the", "this", "it", "that", "a", "an", "and", "or", "but", "if", "when", "where"]
MEDICAL_KEYWORDS = [
    "monitor", "check", "test", "screen", "examine", "follow-up", "follow up", "medication",
    "treatment", "therapy", "lifestyle", "diet", "dietary", "exercise", "blood pressure", "glucose",
    "cholesterol", "diabetes", "appointment", "visit", "consultation", "evaluate", "assess",
    "review", "education", "counseling", "manage", "control", "maintain", "improve", "prevent",
    "reduce", "increase", "supplement", "prescription", "dosage", "medical", "clinical", "health",
    "care", "patient", "provider", "screening", "laboratory", "lab", "hba1c", "hemoglobin", "insulin",
]
HARMFUL_TERMS = ["stop all medication", "discontinue all", "emergency surgery", "immediate surgery",
                 "intensive care", "life threatening"]

# --- fixed values: questions -------------------------------------------------

INTENT_WORDS = [
    ("patient_summary", ["summary", "summarize", "tell me about", "overview"]),
    ("population_health", ["population", "patients", "cohort", "similar"]),
    ("treatment_comparison", ["compare", "comparison", "versus", "vs"]),
    ("medication_interaction", ["interaction", "drug", "medication"]),
    ("timeline_analysis", ["timeline", "progression", "over time"]),
]
DEFAULT_INTENT = "general_medical"
QUERY_CONDITIONS = ["diabetes", "hypertension", "asthma", "copd", "cancer", "pneumonia"]
QUERY_MEDICATIONS = ["metformin", "lisinopril", "atorvastatin", "aspirin", "insulin"]
FOLLOW_UPS = {
    "patient_summary": ["Would you like to see specific lab results?",
                        "Should I compare this patient with similar cases?",
                        "Do you want to analyze the treatment timeline?"],
    "population_health": ["Would you like demographic breakdowns?",
                          "Should I analyze treatment outcomes?",
                          "Do you want to see trending patterns?"],
}
CLEANUP_NOTE = "\n\n*Note: This analysis is for informational purposes only.*"

# --- fixed values: jobs and intake ------------------------------------------

WORKFLOWS = {
    "ocr_only": (["ocr"], 120),
    "ocr_to_ner": (["ocr", "ner"], 180),
    "complete_pipeline": (["ocr", "ner", "chunking", "graph", "insight", "chat"], 480),
    "document_to_graph": (["ocr", "ner", "chunking", "graph", "insight", "chat"], 480),
    "insight_generation": (["insight"], 90),
}
PRIORITIES = {"urgent": 4, "high": 3, "normal": 2, "low": 1}
JOB_STATES = ["queued", "running", "completed", "failed", "cancelled", "retry_pending"]
FINAL_STATES = ["completed", "failed", "cancelled"]

UNSAFE_SIGNATURES = ["<script", "javascript:", "vbscript:", "eval(", "exec("]
DOCUMENT_TYPES = ["lab_report", "prescription", "medical_report", "radiology", "discharge_summary",
                  "clinical_notes", "consent_form", "insurance_claim", "other"]
# extension -> (media type, size limit in bytes)
FILE_TYPES = {
    "pdf": ("application/pdf", 52428800), "txt": ("text/plain", 52428800),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", 26214400),
    "doc": ("application/msword", 26214400), "png": ("image/png", 10485760),
    "jpg": ("image/jpeg", 10485760), "jpeg": ("image/jpeg", 10485760), "tiff": ("image/tiff", 10485760),
    "tif": ("image/tiff", 10485760), "xls": ("application/vnd.ms-excel", 26214400),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", 26214400),
}
DEFAULT_SIZE_LIMIT = 52428800
UPLOAD_ACTIONS = {
    "completed": ["View extracted text", "Download processed files", "View medical entities",
                  "Access patient timeline"],
    "failed": ["Retry processing", "View error details", "Re-upload files"],
    "other": ["Check processing status", "Cancel processing"],
}

# --- fixed values: result texts ----------------------------------------------

NEXT_STEPS = {
    "none": "Consider text preprocessing or different extraction models",
    "few": "Ready for timeline structuring and relationship analysis",
    "many": "Ready for knowledge graph construction and entity linking",
}
EXTRACTION_ADVICE = {
    "none": "Consider adjusting confidence threshold or processing mode",
    "many": "Consider text chunking for better performance",
    "unsure": "Consider using higher accuracy processing mode",
}
OCR_ISSUES = {"quality": "Low image quality detected", "confidence": "Low OCR confidence"}
MEDICATION_REQUIREMENTS = ["Monitor patient response", "Track medication adherence"]
LIFESTYLE_REQUIREMENTS = ["Monitor patient adherence to lifestyle changes", "Assess progress at follow-up visits"]
# always present, or present with one of the words
MONITORING_REQUIREMENTS = [
    (None, "Regular follow-up assessments"),
    (["blood", "lab"], "Laboratory monitoring"),
    (["appointment", "visit"], "Scheduled clinical visits"),
    (["vital"], "Vital signs monitoring"),
]
LIFESTYLE_ACTIONS = [
    (["exercise", "activity"], "Consult with healthcare provider before starting new exercise program"),
    (["diet", "nutrition"], "Consider consultation with registered dietitian"),
]
NO_MEDICATION = "No current medication"
GENERAL_MONITORING = "General Health Monitoring"
LIFESTYLE_TITLE = "Lifestyle Modification Recommendation"
EMPTY_TIMELINE = "No timeline entries met the confidence threshold."
REQUEST_ERRORS = {
    "documents": "At least one document_id or file_path must be provided",
    "retries": "max_retries must be between 0 and 10",
    "timeout": "timeout_seconds must be between 30 and 3600",
    "workflow": "Invalid workflow_type: ",
}

# --- fixed values: character rewrites of recognized text, in order ------------

# (gate, pattern, replacement); with one group in the pattern, "$10" is group 1 and a zero
OCR_STEPS = [
    ("digit", r"[Il](?=\d|$|\s)", "1"), ("digit", r"O(?=\d|$|\s)", "0"),
    ("letters", r"1(?=[a-zA-Z])", "l"), ("letters", r"0(?=[a-zA-Z])", "O"),
    (None, "rn", "m"), (None, "cl", "d"),
    (None, r"l(\d+)", "1$1"), (None, r"(\d+)O", "$10"), (None, r"O(\d+)", "0$1"),
    (None, r"(\d+)o", "$10"), (None, r"o(\d+)", "0$1"),
]

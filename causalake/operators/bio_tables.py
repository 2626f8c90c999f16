"""Fixed dimension tables of the classifiers."""

from __future__ import annotations

# Disease names by class, in order of precedence.
DISEASE_NAMES = {
    "hiv": "infectious_viral",
    "hiv-1": "infectious_viral",
    "hiv/aids": "infectious_viral",
    "aids": "infectious_viral",
    "covid-19": "infectious_viral",
    "sars-cov-2": "infectious_viral",
    "ebola": "infectious_viral",
    "ebola virus disease": "infectious_viral",
    "hepatitis b": "infectious_viral",
    "hepatitis c": "infectious_viral",
    "influenza": "infectious_viral",
    "dengue": "infectious_viral",
    "zika": "infectious_viral",
    "malaria": "infectious_parasitic",
    "trypanosomiasis": "infectious_parasitic",
    "chagas disease": "infectious_parasitic",
    "leishmaniasis": "infectious_parasitic",
    "schistosomiasis": "infectious_parasitic",
    "toxoplasmosis": "infectious_parasitic",
    "tuberculosis": "infectious_bacterial",
    "cholera": "infectious_bacterial",
    "meningitis": "infectious_bacterial",
    "pneumonia": "infectious_bacterial",
    "sepsis": "infectious_bacterial",
    "lyme disease": "infectious_bacterial",
    "lung cancer": "cancer",
    "breast cancer": "cancer",
    "colorectal cancer": "cancer",
    "pancreatic cancer": "cancer",
    "prostate cancer": "cancer",
    "leukemia": "cancer",
    "lymphoma": "cancer",
    "melanoma": "cancer",
    "glioblastoma": "cancer",
    "type 2 diabetes": "metabolic",
    "type 1 diabetes": "autoimmune",
    "obesity": "metabolic",
    "metabolic syndrome": "metabolic",
    "nafld": "metabolic",
    "alzheimer disease": "neurodegenerative",
    "alzheimer's disease": "neurodegenerative",
    "parkinson disease": "neurodegenerative",
    "parkinson's disease": "neurodegenerative",
    "huntington disease": "neurodegenerative",
    "als": "neurodegenerative",
    "amyotrophic lateral sclerosis": "neurodegenerative",
    "rheumatoid arthritis": "autoimmune",
    "lupus": "autoimmune",
    "multiple sclerosis": "autoimmune",
    "crohn's disease": "autoimmune",
    "cystic fibrosis": "genetic",
    "sickle cell disease": "genetic",
}

# Symptom marker genes by family.
MARKER_FAMILIES = {
    "GABA_receptors": "GABRA1 GABRA2 GABRA3 GABRA4 GABRA5 GABRA6 GABRB1 GABRB2 GABRB3 GABRD GABRE GABRG1 GABRG2 GABRG3 GABRP GABRQ GABRR1 GABRR2 GABRR3",
    "sodium_channels": "SCN1A SCN2A SCN3A SCN4A SCN5A SCN7A SCN8A SCN9A SCN10A SCN11A SCN1B SCN2B SCN3B SCN4B",
    "potassium_channels": "KCNA1 KCNA2 KCNA3 KCNA4 KCNA5 KCNB1 KCNB2 KCNC1 KCNC2 KCND1 KCND2 KCND3 KCNQ1 KCNQ2 KCNQ3 KCNQ4 KCNQ5",
    "glutamate_receptors": "GRIN1 GRIN2A GRIN2B GRIN2C GRIN2D GRM1 GRM2 GRM3 GRM4 GRM5 GRM6 GRM7 GRM8 GRIA1 GRIA2 GRIA3 GRIA4",
    "dopamine_receptors": "DRD1 DRD2 DRD3 DRD4 DRD5",
    "serotonin_receptors": "HTR1A HTR1B HTR2A HTR2B HTR2C HTR3A HTR3B HTR4 HTR5A HTR6 HTR7",
    "coagulation_factors": "F2 F5 F7 F8 F9 F10 F11 F12 F13A1 SERPINC1 SERPIND1 PROC PROS1 THBD",
    "acute_phase_proteins": "CRP SAA1 SAA2 HP HPR ORM1 ORM2 SERPINA3 FGA FGB FGG",
    "neuronal_structural": "NEFH NEFL NEFM MAP2 MAPT TUBB3 SYN1 SYN2 SYP SNAP25",
}

# Entry factors of pathogens, and GO terms of entry.
ENTRY_FACTORS = "GYPA GYPB GYPC CR1 DARC BSG CCR5 CXCR4 CD4 ACE2 TMPRSS2 NRP1 NPC1 LAMP1"
ENTRY_TERMS = ("GO:0046718", "GO:0044409", "GO:0020002")

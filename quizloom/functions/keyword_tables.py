"""The curated rules that give a question its topics, in order of precedence. Rules may be read from elsewhere instead."""

from __future__ import annotations

#: Fixed: (pattern, codes, skills) for the words of a stem, whatever their case; dots span lines.
STEM_KEYWORDS = [
    (r"\b(hess(?:'?s)?\s+law|energy cycle|enthalpy change of formation|enthalpy of formation|reaction pathway diagram|reaction profile|calculate.{0,40}enthalpy|bond energ(?:y|ies))\b", "5.1 5.2", "calculate"),
    (r"\b(enthalpy|hess|ΔH|∆H|delta H)\b", "5.1 5.2", "calculate"),
    (r"\b(boltzmann|molecular energy|number of molecules)\b", "8.2", "explain recall"),
    (r"\b(heat exchanger|haber process)\b", "8.1 12.1", "explain"),
    (r"\b(catalysts?)\b", "8.3 8.1", "explain recall"),
    (r"\b(rate of reaction|activation energy)\b", "8.1", "explain"),
    (r"\b(ionisation|ionization)\s+energy\b", "1.4", "explain recall"),
    (r"\b(period 3).*\b(p electron|oxide|amphoteric)|\b(forms a solid oxide)\b.*\b(hydroxide|hydrochloric)\b", "9.2 1.3", "recall compare"),
    (r"\b(unpaired|p electron|electron configuration)\b", "1.3", "recall"),
    (r"\b(isotope)\b", "1.2", "recall"),
    (r"\b(shape of|bond angle)\b", "3.5", "recall draw"),
    (r"\b(volatility|intermolecular)\b", "11.1 3.6", "explain compare"),
    (r"\b(ideal gas|pV\s*=\s*nRT)\b", "4.1", "calculate"),
    (r"\b(oxidation number|oxidation state|redox|half[- ]equation)\b", "6.1", "recall explain"),
    (r"\b(Kc|Kp|equilibrium constant)\b", "7.1 7.2", "calculate explain"),
    (r"\b(citric acid)\b|\b(excess of sodium metal)\b.*\b(acid|CO2H)\b|\b(CO2H)\b.*\b(HO|OH)\b", "18.1 16.1 2.2", "calculate recall"),
    (r"\b(molecular formula)\b", "13.1", "recall"),
    (r"\b(SN2|bromoethane|cyanide|propanenitrile)\b", "15.1 19.2", "explain recall"),
    (r"\b(cis[- ]trans|optical isomerism|chirality)\b", "13.4", "recall"),
    (r"\b(produce two different carboxylic acids|acidified manganate)\b", "14.2", "recall"),
    (r"\b(ester|reflux).*(sodium hydroxide|NaOH)|CO2C|palmitate", "18.2", "recall"),
    (r"\b(complete combustion|minimum mass|combustion of)\b.*\b(dm3|g\b|mass)\b|\b(mass of oxygen)\b", "2.4", "calculate"),
    (r"\d+(?:\.\d+)?\s*g of \w+ contains|\bcontains\b.*\b\d+(?:\.\d+)?\s*g\b|\bempirical formula\b", "2.3 2.4", "calculate"),
    (r"\b(largest number of|how many (moles|atoms|molecules)|avogadro|number of (hydrogen )?atoms)\b", "2.2", "calculate recall"),
    (r"\b(reacts with Cl\s*[₂2]|reacts with chlorine)\b|\b(NH[₄4]Cl)\b.*\b(Cl\s*[₂2]|chlorine)\b|\b(Cl\s*[₂2]|chlorine)\b.*\b(NH[₄4]Cl|NH[₃3]|ammonia)\b", "12.1 11.4", "explain recall"),
    (r"\b(acid rain|nitrogen dioxide|\bNO2\b)\b", "12.1", "explain recall"),
    (r"\b(silver nitrate|halide).*(ammonia|NH3)|\b(concentrated ammonia solution)\b", "11.3", "practical recall"),
    (r"\b(group\s*2|alkaline earth|magnesium nitrate|thermal decomposition of hydrated)\b", "10.1", "recall"),
    (r"\b(group\s*17|halogen molecule|chlorine, bromine and iodine)\b", "11.1", "recall compare"),
    (r"\b(going across period|across period 3|periodicity|periodic table|atomic radius)\b", "9.1", "recall compare"),
    (r"\b(iodoform|carbonyl|aldehyde|ketone|HCN|hydroxynitrile)\b", "17.1 19.2", "recall"),
    (r"\b(alcohol|phenol)\b", "16.1", "recall"),
    (r"\b(electrophilic addition|reaction of .* alkene)\b", "14.2", "recall"),
    (r"\b(hydrocarbon|functional group|structural isomer)\b", "13.1", "recall"),
    (r"\b(haber|manufacture of ammonia)\b", "12.1", "explain"),
    (r"\b(dot-and-cross|VSEPR)\b", "3.2 3.4", "recall draw"),
]
#: Fixed: the same for the words of a whole question, asked where no stem word decides; the last ones are fallbacks.
BODY_KEYWORDS = [(r"\b(mol\b|mole|avogadro)\b", "2.2", "calculate recall"), (r"\b(enthalpy|ΔH)\b", "5.1 5.2", "calculate")]
FALLBACK_KEYWORDS = [(r"\b(C\d+H\d+|organic|structure)\b", "13.1", "recall"), (r"\b(mol\b|mass|dm3|gaseous product)\b", "2.2", "calculate"), ("", "2.2", "recall")]

#: Fixed: (pattern, codes, outcomes, skills) for questions of structured papers, asked before all others.
OUTCOME_KEYWORDS = [
    (r"\bstereoisomer", "13.4", "13.4-2", "explain"), (r"\bcoordinate bond|dative", "3.4", "3.4-1c", "explain"), (r"\bdot[- ]and[- ]cross|dot and cross", "3.7", "3.7-1", "draw"),
    (r"\bBr[oø]nsted", "7.2", "7.2-3", "define"), (r"\bweak acid", "7.2", "7.2-4", "recall"), (r"\bstrong .{0,20}acid", "7.2", "7.2-4", "recall"),
    (r"\bconjugate base", "7.2", "7.2-3", "recall"), (r"\bdynamic equilibrium", "7.1", "7.1-1b", "explain"), (r"\bKp\b", "7.1", "7.1-6", "calculate"), (r"\bKc\b", "7.1", "7.1-4", "calculate"),
    (r"\bpartial pressure|mole fraction", "7.1", "7.1-5", "calculate"), (r"\bideal gas", "4.1", "4.1-2", "explain"), (r"\bpV\s*=\s*nRT|ideal gas equation", "4.1", "4.1-3", "calculate"),
    (r"\bvapour pressure", "4.1", "4.1-1", "explain"), (r"\bBoltzmann|activation energy|Eₐ|Ea\b", "8.2", "8.2-2", "explain"), (r"\brate of reaction", "8.1", "8.1-1", "explain"),
    (r"\bhomogeneous", "8.3", "8.3-1a", "explain"), (r"\bionisation energy|ionization energy", "1.4", "1.4-3", "explain"), (r"\belectron configuration|1s²|1s2", "1.3", "1.3-6", "recall"),
    (r"\bhybridis|hybridiz|sp²|sp2|sp³|sp3|\bsp\b", "3.4", "3.4-2c", "recall"), (r"\bbond angle", "3.5", "3.5-1", "recall"),
    (r"\bvan der Waals|intermolecular|instantaneous dipole|permanent dipole", "3.6", "3.6-3b", "explain"), (r"\bhydrogen bond", "3.6", "3.6-1a", "explain"),
    (r"\bdipole moment|electronegativ", "3.6 3.1", "3.6-2 3.1-1", "explain"), (r"\bgiant ionic|lattice structure|melting point", "4.2", "4.2-2", "explain"),
    (r"\bGroup 2|thermal (stability|decomposition).*nitrate|Ca\(OH\)|calcium hydroxide", "10.1", "10.1-3", "recall"), (r"\bGroup 17|halogen|AgNO₃|AgNO3|cream precipitate|AgBr", "11.3", "11.3-2a", "recall"),
    (r"\bconcentrated sulfuric|conc\.?\s*H2SO4|concentrated H₂SO₄", "11.3", "11.3-2b", "recall"), (r"\bdisproportionation", "6.1", "6.1-3", "define"),
    (r"\boxidation number|oxidation state|redox", "6.1", "6.1-3", "explain"), (r"\bPeriod 3|P4O10|P₄O₁₀|ceramic|amphoteric", "9.2", "9.2-4", "explain"),
    (r"\banionic radius|atomic radius|ionic radius", "1.1 9.1", "1.1-7 9.1-1", "explain"), (r"\benthalpy change of combustion|ΔHc|∆Hc", "5.1", "5.1-3b", "define"),
    (r"\benthalpy change of formation|ΔHf|∆Hf|standard enthalpy", "5.1", "5.1-3b", "define"), (r"\bbond energy|Hess", "5.1 5.2", "5.1-5", "calculate"), (r"\binfrared|IR spectrum|wavenumber", "22.1", "22.1-1", "explain"),
    (r"\bTollens|Fehling|2,4-DNPH|2,4-dinitrophenylhydrazine", "17.1", "17.1-5", "recall"), (r"\bnucleophilic substitution|SN1|SN2", "15.1 13.2", "15.1-5 13.2-2c", "recall"),
    (r"\belectrophilic addition|Markovnikov|carbocation", "14.2", "14.2-5", "explain"), (r"\bfree[- ]radical|initiation|propagation|termination|ultraviolet|UV light", "14.1 13.2", "14.1-3 13.2-2a", "recall"),
    (r"\bdehydrat|concentrated sulfuric acid.*propene|alkene.*alcohol", "14.2 16.1", "14.2-1b", "recall"), (r"\bNaCN|KCN|nitrile|C≡N|C→N", "15.1 18.1", "15.1-3b", "recall"),
    (r"\bNaBH4|NaBH₄|LiAlH4|LiAlH₄|reduc", "17.1", "17.1-2a", "recall"), (r"\bCr2O7|Cr₂O₇|acidified.*oxid", "16.1", "16.1-2d", "recall"),
    (r"\bSOCl2|SOCl₂|PBr3|PBr₃|halogenoalkane", "15.1 16.1", "15.1-1c", "recall"), (r"\bpolymer|addition polymerisation", "20.1", "20.1-1", "recall"), (r"\bvolatile", "11.1 3.6", "11.1-3", "recall"),
    (r"\benvironmental consequences|acid rain|SO2\(g\)", "12.1 14.1", "12.1-5", "recall"), (r"\bnitrogen.*reactivity|lack of reactivity of nitrogen", "12.1", "12.1-1", "explain"),
    (r"\bsystematic name", "13.1", "13.1-5", "recall"), (r"\bdisplayed formula|skeletal formula", "13.1", "13.1-4", "draw"), (r"\bchiral|optical isomer", "13.4", "13.4-4", "identify"),
]
#: Fixed: usual names of skills, and what stands in where no rule's topic is known.
SKILL_NAMES = {"predict": "explain", "identify": "recall", "construct": "recall", "define": "recall"}
ORGANIC, ORGANIC_CODE, OTHER_CODE = r"(?i)\b(organic|alkene|alcohol|C\d+H)", "13.1", "2.3"

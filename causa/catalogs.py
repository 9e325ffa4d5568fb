"""Catalogs that operators take as arguments: patterns, names, limits."""

from __future__ import annotations

# Spellings, patterns and names that results are defined by.
ACCENTS = ("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
NULL_MARKERS = ("n/a", "na", "não informado", "nao informado", "null", "none", "-", "")
TRUE_WORDS = ("true", "sim", "1", "yes", "deferido", "deferida")
FALSE_WORDS = ("false", "não", "nao", "0", "no", "indeferido", "indeferida")

#: Item names in order; the first match wins.
CANONICAL_ITEMS = (
    (r"horas?\s*extras?", "Horas Extras"),
    (r"adicional\s*noturno", "Adicional Noturno"),
    (r"adicional\s*de\s*insalubridade", "Adicional de Insalubridade"),
    (r"adicional\s*de\s*periculosidade", "Adicional de Periculosidade"),
    (r"dsr|descanso\s*semanal", "DSR"),
    (r"f\.?g\.?t\.?s", "FGTS"),
    (r"f[eé]rias", "Férias"),
    (r"13[°º]?\s*sal[aá]rio|gratifica", "13º Salário"),
    (r"aviso\s*pr[eé]vio", "Aviso Prévio"),
    (r"saldo\s*de\s*sal[aá]rio", "Saldo de Salário"),
    (r"intervalo\s*intrajornada", "Intervalo Intrajornada"),
    (r"dano\s*moral", "Dano Moral"),
    (r"dano\s*material", "Dano Material"),
    (r"multa\s*(?:do\s*)?art\.?\s*477", "Multa Art. 477 CLT"),
    (r"multa\s*(?:do\s*)?art\.?\s*467", "Multa Art. 467 CLT"),
)
#: Keys of the duplicate check.
CANONICAL_KEYS = (
    (r"horas?\s*extras?", "horas_extras"),
    (r"adicional\s*noturno", "adicional_noturno"),
    (r"adicional\s*de\s*insalubridade", "insalubridade"),
    (r"adicional\s*de\s*periculosidade", "periculosidade"),
    (r"dsr|descanso\s*semanal", "dsr"),
    (r"f\.?g\.?t\.?s", "fgts"),
    (r"f[eé]rias", "ferias"),
    (r"13[°º]?\s*sal[aá]rio|gratifica", "decimo_terceiro"),
    (r"aviso\s*pr[eé]vio", "aviso_previo"),
    (r"saldo\s*de\s*sal[aá]rio", "saldo_salario"),
    (r"intervalo\s*intrajornada", "intervalo_intrajornada"),
    (r"dano\s*moral", "dano_moral"),
    (r"dano\s*material", "dano_material"),
    (r"multa.*467", "multa_467"),
    (r"multa.*477", "multa_477"),
    (r"seguro.desemprego", "seguro_desemprego"),
)
#: Phrases with their keys, in rank order. Keys are defined by these spellings and by their order.
PHRASES = (
    ("décimo terceiro salário proporcional", "decimo_terceiro_proporcional"),
    ("décimo terceiro proporcional", "decimo_terceiro_proporcional"),
    ("13° proporcional", "decimo_terceiro_proporcional"),
    ("13º proporcional", "decimo_terceiro_proporcional"),
    ("gratificação natalina proporcional", "decimo_terceiro_proporcional"),
    ("décimo terceiro salário", "decimo_terceiro"),
    ("13° salário", "decimo_terceiro"),
    ("13º salário", "decimo_terceiro"),
    ("gratificação natalina", "decimo_terceiro"),
    ("férias proporcionais + 1/3", "ferias_proporcionais_com_terco"),
    ("férias proporcionais mais um terço", "ferias_proporcionais_com_terco"),
    ("férias + um terço", "ferias_proporcionais_com_terco"),
    ("férias proporcionais", "ferias_proporcionais"),
    ("férias vencidas em dobro", "ferias_dobro"),
    ("férias em dobro", "ferias_dobro"),
    ("férias vencidas", "ferias_vencidas"),
    ("férias indenizadas", "ferias_indenizadas"),
    ("abono pecuniário", "abono_pecuniario_ferias"),
    ("abono de férias", "abono_pecuniario_ferias"),
    ("horas extras acima da 8ª diária", "horas_extras_diarias"),
    ("horas extras acima da oitava diária", "horas_extras_diarias"),
    ("labor em sobrejornada", "horas_extras_diarias"),
    ("sobrejornada", "horas_extras_diarias"),
    ("horas extras acima da 44ª semanal", "horas_extras_semanais"),
    ("horas extras acima da quadragésima quarta", "horas_extras_semanais"),
    ("horas extras", "horas_extras_diarias"),
    ("horas extraordinárias", "horas_extras_diarias"),
    ("descanso semanal remunerado", "dsr"),
    ("repouso semanal remunerado", "dsr"),
    ("dsr", "dsr"),
    ("rsr", "dsr"),
    ("fgts + multa de 40%", "fgts_com_multa"),
    ("fgts e multa rescisória de 40%", "fgts_com_multa"),
    ("fgts com multa", "fgts_com_multa"),
    ("depósitos do fgts", "fgts_depositos"),
    ("fgts", "fgts_depositos"),
    ("multa rescisória de 40%", "multa_fgts_40"),
    ("multa de 40% do fgts", "multa_fgts_40"),
    ("aviso prévio indenizado", "aviso_previo_indenizado"),
    ("aviso prévio trabalhado", "aviso_previo_trabalhado"),
    ("aviso prévio proporcional", "aviso_previo_proporcional"),
    ("aviso prévio", "aviso_previo_indenizado"),
    ("saldo de salário", "saldo_salario"),
    ("saldo salarial", "saldo_salario"),
    ("multa do artigo 467", "multa_art_467"),
    ("multa art. 467", "multa_art_467"),
    ("multa art 467", "multa_art_467"),
    ("multa do artigo 477", "multa_art_477"),
    ("multa art. 477", "multa_art_477"),
    ("multa art 477", "multa_art_477"),
    ("dano moral", "dano_moral"),
    ("indenização por danos morais", "dano_moral"),
    ("dano material", "dano_material"),
    ("indenização por danos materiais", "dano_material"),
    ("dano existencial", "dano_existencial"),
    ("honorários advocatícios", "honorarios_advocaticios"),
    ("honorários sucumbenciais", "honorarios_advocaticios"),
    ("honorários de sucumbência", "honorarios_advocaticios"),
    ("adicional de insalubridade", "adicional_insalubridade"),
    ("insalubridade", "adicional_insalubridade"),
    ("adicional de periculosidade", "adicional_periculosidade"),
    ("periculosidade", "adicional_periculosidade"),
    ("adicional noturno", "adicional_noturno"),
    ("adicional de transferência", "adicional_transferencia"),
    ("ipca-e", "IPCAE"),
    ("ipca e", "IPCAE"),
    ("tr", "TR"),
    ("taxa referencial", "TR"),
    ("selic", "SELIC"),
    ("taxa selic", "SELIC"),
    ("salário base", "salario_base"),
    ("salário contratual", "salario_base"),
    ("última remuneração", "ultima_remuneracao"),
    ("remuneração", "ultima_remuneracao"),
    ("salário hora", "salario_hora"),
    ("valor hora", "salario_hora"),
)
#: Official names by alias, in order.
ALIASES = (
    ("art. 477", "Multa Art. 477 CLT"),
    ("art. 467", "Multa Art. 467 CLT"),
    ("13º", "13º Salário Proporcional"),
    ("décimo terceiro", "13º Salário Proporcional"),
    ("aviso prévio indenizado", "Aviso Prévio Indenizado"),
    ("saldo salarial", "Saldo de Salário"),
    ("ferias + 1/3", "Férias Proporcionais + 1/3"),
    ("ferias em dobro", "Férias em Dobro"),
    ("horas extras", "Horas Extras"),
    ("hora extra", "Horas Extras"),
    ("adicional noturno", "Adicional Noturno"),
    ("insalubridade", "Adicional de Insalubridade"),
    ("fgts + 40%", "FGTS + Multa de 40%"),
)
#: Official names by the wordings under which a text names an item, in order. Names are defined by these wordings.
NAMED_IN_TEXT = (
    ("art. 477", "Multa Art. 477 CLT"),
    ("art 477", "Multa Art. 477 CLT"),
    ("art. 467", "Multa Art. 467 CLT"),
    ("art 467", "Multa Art. 467 CLT"),
    ("13o", "13º Salário Proporcional"),
    ("13º", "13º Salário Proporcional"),
    ("13°", "13º Salário Proporcional"),
    ("décimo terceiro", "13º Salário Proporcional"),
    ("pagamento de aviso", "Aviso Prévio Indenizado"),
    ("aviso previo", "Aviso Prévio Indenizado"),
    ("aviso prévio indenizado", "Aviso Prévio Indenizado"),
    ("aviso prévio trabalhado", "Aviso Prévio Trabalhado"),
    ("aviso prévio proporcional", "Aviso Prévio Proporcional"),
    ("saldo salarial", "Saldo de Salário"),
    ("saldo de salario", "Saldo de Salário"),
    ("13 proporcional", "13º Salário Proporcional"),
    ("13º proporcional", "13º Salário Proporcional"),
    ("decimo terceiro proporcional", "13º Salário Proporcional"),
    ("13 integral", "13º Salário Integral"),
    ("ferias proporcionais", "Férias Proporcionais + 1/3"),
    ("ferias + 1/3", "Férias Proporcionais + 1/3"),
    ("ferias vencidas", "Férias Vencidas + 1/3"),
    ("ferias em dobro", "Férias em Dobro"),
    ("ferias indenizadas", "Férias Indenizadas"),
    ("horas extras", "Horas Extras"),
    ("hora extra", "Horas Extras"),
    ("adicional noturno", "Adicional Noturno"),
    ("insalubridade", "Adicional de Insalubridade"),
    ("periculosidade", "Adicional de Periculosidade"),
    ("intervalo intrajornada", "Intervalo Intrajornada"),
    ("multa art 467", "Multa art. 467 CLT"),
    ("multa art 477", "Multa art. 477 CLT"),
    ("multa 467", "Multa art. 467 CLT"),
    ("multa 477", "Multa art. 477 CLT"),
    ("fgts + 40%", "FGTS + Multa de 40%"),
    ("fgts e multa", "FGTS + Multa de 40%"),
    ("multa 40% fgts", "Multa de 40% do FGTS"),
    ("dsr", "DSR"),
    ("repouso semanal", "DSR"),
)
# Patterns of citations, in the order in which they are looked for.
CITATIONS = (
    r"(?i)S[uú]mula\s+n[°º]?\s*\d+\s+(?:do\s+)?TST",
    r"(?i)S[uú]mula\s+n[°º]?\s*\d+\s+(?:do\s+)?STF",
    r"(?i)OJ\s+n[°º]?\s*\d+",
    r"(?i)art(?:igo)?\.?\s*\d+[,\s\w]*(?:da\s+CLT|CLT)",
    r"(?i)ADC\s+\d+",
    r"(?i)S[uú]mula\s+n[°º]?\s*\d+",
    r"(?i)Lei\s+n[°º]?\s*[\d\.]+",
    r"(?i)Decreto[- ]Lei\s+n[°º]?\s*[\d\.]+",
)
# What a page holds that begins a decision, rules, is a cover of something else, or tells the kind of document.
PAGE_FLAGS = {
    "envelope": r"(?i)(Fica V\. Sa\. intimado|INTIMAÇÃO\s*$|Certidão de Disponibilização|Certidão de Trânsito|CERTIDÃO\s*-\s*PJe|Certidão de comparecimento|Certidão de Distribuição|ATA DE AUDIÊNCIA|NOTIFICAÇÃO JUDICIAL|CARTA DE PREPOSIÇÃO|PROCURAÇÃO|Relatório de Assinaturas|DECLARAÇÃO DE HIPOSSUFICIÊNCIA|Sua Petição foi finalizada|SUMÁRIO\s*\nDocumentos)",
    "opening": r"(?i)(FUNDAMENTA[ÇC][AÃ]O|RELATÓRIO|VISTOS[,.]|VISTOS, RELATADOS E DISCUTIDOS|ACÓRDÃO|EMENTA)",
    "ruling": r"(?i)(DISPOSITIVO|ANTE O EXPOSTO|ISTO POSTO|PELO EXPOSTO|JULGO PROCEDENTE|JULGO PARCIALMENTE|JULGO IMPROCEDENTE|CONDENO A RECLAMADA|ACORDAM)",
    "appeal": r"(?i)(VISTOS, RELATADOS E DISCUTIDOS|TURMA.*REGIONAL|DESEMBARGADOR|EMENTA\s*\n|ACÓRDÃO\s*\n)",
    "settlement": r"(?i)(fase\s+de\s+liquida[çc][aã]o|homologa[çc][aã]o\s+de\s+c[aá]lculos|c[aá]lculos\s+apresentados\s+pela\s+contadoria|impugna[çc][aã]o\s+aos\s+c[aá]lculos|despacho\s+de\s+liquida[çc][aã]o|t[ií]tulo\s+executivo\b)",
    "motion": r"(?i)(embargos\s+de\s+declara[çc][aã]o|efeito\s+infringente|embargante\b)",
    "order": r"(?i)(fase\s+de\s+execu[çc][aã]o|cumpra-?se\b|requisi[çc][aã]o\s+de\s+pagamento|\bRPV\b|precat[oó]rio\b|planilha\s+de\s+d[eé]bito|BACENJUD|SISBAJUD|intime-?se\s+a\s+executad)",
}
# Wordings by which a clause grants or denies.
GRANTED = r"(?i)\b(deferid[oa]s?|defiro|condenad[oa]|procedente|pagamento de|devo pagar|fica condenad[oa])\b"
DENIED = r"(?i)(\bindeferid[oa]s?\b|\bindefiro\b|\bimprocedente\b|não há|não faz jus|não se reconhece|não reconheço|\bafasto\b|\brejeito\b)"
# Names of pieces in a table of contents, the first that a line holds counts.
CONTENTS_KINDS = (
    ("petition", r"(?iu)(peti[çc][aã]o\s+inicial|reclama[çc][aã]o\s+trabalhista|inicial)"),
    ("defence", r"(?iu)(contesta[çc][aã]o|defesa\s+do\s+reclamado)"),
    ("sentence", r"(?iu)(senten[çc]a|decis[aã]o\s+de\s+1[°º]?\s*grau)"),
    ("appeal", r"(?iu)(ac[oó]rd[aã]o|recurso\s+ordin[aá]rio|recurso\s+de\s+revista|trt|tst)"),
    ("settlement", r"(?iu)(liquida[çc][aã]o|c[aá]lculos?\s+de\s+liquida[çc][aã]o|resumo\s+do\s+c[aá]lculo|pje[- ]?calc)"),
    ("objection", r"(?iu)(impugna[çc][aã]o\s+aos?\s+c[aá]lculos?|manifesta[çc][aã]o\s+sobre\s+os\s+c[aá]lculos?)"),
    ("opinion", r"(?iu)(parecer\s+t[eé]cnico|esclarecimentos\s+periciais|manifesta[çc][aã]o\s+pericial)"),
)
CONTENTS_HEADING = r"(?iu)SUM[ÁA]RIO"
CONTENTS_PAGE = r"(?i)\b(?:p[aáÁ]g\.?)?\s*(\d{1,4})\s*$"
# Where a piece begins and ends in the text of a file without contents.
ANCHORS = (
    ("petition", r"(?iu)(EXCELENT[ÍI]SSIMO|RECLAMA[ÇC][AÃ]O\s+TRABALHISTA|Vara\s+do\s+Trabalho)", r"(?iu)(D[aá]-se\s+[àa]\s+causa\s+o\s+valor|Termos\s+em\s+que[,.]\s*Pede\s+deferimento|Nestes\s+termos)"),
    ("defence", r"(?iu)(CONTESTA[ÇC][AÃ]O|DEFESA|PRELIMINARMENTE|NO\s+M[EÉ]RITO)", r"(?iu)(Requer\s+a\s+improced[eê]ncia|Termos\s+em\s+que[,.]\s*Pede\s+deferimento)"),
    ("settlement", r"(?iu)(C[AÁ]LCULOS?\s+DE\s+LIQUIDA[ÇC][AÃ]O|RESUMO\s+DO\s+C[AÁ]LCULO|PJe[- ]?Calc)", None),
    ("objection", r"(?iu)(IMPUGNA[ÇC][AÃ]O\s+AOS?\s+C[AÁ]LCULOS?|MANIFESTA[ÇC][AÃ]O\s+SOBRE\s+OS\s+C[AÁ]LCULOS?)", r"(?iu)(Requer\s+a\s+retifica[çc][aã]o|Pede\s+deferimento)"),
    ("opinion", r"(?iu)(PARECER\s+T[EÉ]CNICO|ESCLARECIMENTOS\s+PERICIAIS|Vem\s+respeitosamente\s+apresentar)", None),
)
# What begins the repeated tail of a text.
REPEAT_NOTICE = (
    r"(?iu)(Fica V\. Sa\. intimado para tomar ciência da Senten[çc]a|Fica V\. Sa\. intimado para tomar ciência do Ac[oó]rd[aã]o|Certidão de Disponibilização e Publicação|INTIMAÇÃO\s*\nFica V\. Sa\. intimado)"
)
REPEAT_RULING = (
    r"(?iu)(DISPOSITIVO\s*\n|ANTE O EXPOSTO[,.]|ISTO POSTO[,.]|PELO EXPOSTO[,.]|DIANTE DO EXPOSTO[,.]|JULGO PROCEDENTE|JULGO PARCIALMENTE|JULGO IMPROCEDENTE|CONDENO A RECLAMADA|ACORDAM\b)"
)
PAGE_LABEL = "--- PÁGINA"
#: Names of elements of a calculation file, in the order in which they are looked for.
CALCULATION_TAGS = {"parameters": ("ParametrosDeAtualizacao",), "idx": ("indiceTrabalhista", "indice"), "interest": ("juros",), "divisor": ("valorCargaHorariaPadrao", "divisor"), "item": ("Verba", "verba"), "name": ("nome",)}
SIGNED_ON = r"(?is)assinado eletronicamente.*?em\s+(\d{2}/\d{2}/\d{4})"
#: Hours a week to the divisor of monthly pay.
DIVISORS = {30: 150, 35: 175, 36: 180, 40: 200, 44: 220}
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
PLANS = (("free", 5), ("basic", 50), ("pro", 200), ("firm", -1))
MINIMUM_WAGE = 1518
#: base from, base to, rate, deduction
BRACKETS = ((0, 2259.20, 0.0, 0.0), (2259.20, 2826.65, 7.5, 169.44), (2826.65, 3751.05, 15.0, 381.44), (3751.05, 4664.68, 22.5, 662.77), (4664.68, 1e12, 27.5, 896.00))

# A catalog for texts without legal content.
GENERIC_FIELDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "high"),
    ("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "high"),
    ("token", r"token = \"([0-9a-f]{16,})\"", "high"),
    ("long_number", r"\b\d{12,19}\b", "medium"),
    ("license", r"(?i)(licen[sc]e[^\n]{0,80})", "medium"),
)

#: Wordings by priority: (pattern, label, tier). The fields are defined by these wordings and labels.
DISMISSAL_REASONS = (
    (r"\brescisão\s+indireta\b", "Rescisão indireta", "medium"),
    (r"\b(?:dispensad[oa]|dispensou|demissão|demitiu)\b.{0,60}\bsem\s+justa\s+causa\b", "Sem justa causa", "medium"),
    (r"\bcom\s+justa\s+causa\b", "Com justa causa", "medium"),
    (r"\b(?:pedido\s+de\s+demissão|demitiu[-\s]+se|pediu\s+demissão)\b", "Pedido de demissão", "medium"),
    (r"\btérmino\s+do\s+(?:prazo\s+do\s+)?contrato\b", "Término de contrato", "medium"),
)
CONTRACT_KINDS = (
    (r"\b(?:contrato|per[íi]odo)\s+de\s+experi[eê]ncia\b", "Experiência", "high"),
    (r"\bcontrato\s+(?:por|a)\s+prazo\s+determinado\b|\bprazo\s+determinado\b.{0,40}\bcontrato\b|\bcontrato\s+(?:de\s+trabalho\s+)?(?:com\s+)?prazo\s+determinado\b", "Prazo determinado", "high"),
    (r"(?s)(?:pejotiza[çc][aã]o|contrato\s+de\s+pessoa\s+jur[ií]dica|CNPJ|MEI\b).{0,60}(?:reconhec|fraude|simula[çc][aã]o|disfarc)", "Pejotização reconhecida", "medium"),
    (r"aut[oô]nomo\b.{0,80}reconhec", "Autônomo reconhecido", "medium"),
    (r"\bv[íi]nculo\s+(?:de\s+)?emprego\b|\bCLT\b", "CLT", "medium"),
)
CASE_NUMBER = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"
NUMBER_LABEL = r"(?:Processo|Autos?|N[oº°]\.?|Nº\s+do\s+Processo)[:\s]+"
PUBLISHED_ON = r"publicad[oa]\s+em\s+(\d{2}/\d{2}/\d{4})"
SIGNED_ANY = r"(?is)assinado\s+(?:eletronicamente|digitalmente).*?em\s+(\d{2}/\d{2}/\d{4})"
SPELLED_AFTER_CITY = r"(?iu)[A-ZÀÁÉÍÓÚ][a-zàáéíóú]+,\s+(\d{1,2}\s+de\s+[A-Za-zçÇ]+\s+de\s+\d{4})"
NOTICE_DAYS = (
    r"aviso\s+pr[eé]vio\s+(?:(?:indenizado|trabalhado|proporcional|integral)\s+)?(?:de\s+)?(\d+)\s*(?:\([^)]{1,20}\)\s*)?dias?",
    r"(\d+)\s*(?:\([^)]{1,20}\)\s*)?dias?\s+de\s+aviso\s+pr[eé]vio",
)

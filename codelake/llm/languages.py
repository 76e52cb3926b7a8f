"""Grammars in the notation of ``syntax.Grammar``, by language; words and signs are those of the languages' own reference manuals."""

from __future__ import annotations

import re
from functools import cache

from codelake.llm.lexing import mask
from codelake.llm.syntax import TICK, Grammar

_JS_SIGNS = ">>>= === !== **= <<= >>= >>> &&= ||= ??= ... == != <= >= && || ?? ?. => ++ -- ** += -= *= /= %= &= |= ^= << >>"
_JS_BINARY = "< === !== == != <= >= && || ?? ** += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= << >> >>> = + - * / % & | ^ in instanceof TERN >"
_CONTINUES = ". ?. , ; : ? ) ] } ( [ { = + - * / % & | ^ => == != <= >= && || ?? += -= *= /= %= &= |= ^= << >> === !== ** TICK"


def _alternatives(tokens: str) -> str:
    """One of several tokens, angle brackets included."""
    return " | ".join(f"'{t}'" if not t.isalpha() else t for t in tokens.split())


_JS = {
    "KEY": "( WORD | LIT | S_a | '#' WORD )",
    "PRE": "( <typeof void delete await yield new ! ~ + - ++ --> | yield '*' | async? ( ID | P_p ) '=>' )",
    "TAIL": "( <. ?.> '#'? WORD | '?.'? P_e | '?.'? S_a | TICK )",
    "ATOM": "( ID | LIT | <this super null true false> | P_1 | S_a | B_o | async? function '*'? ID? P_p B_s | class ID? ( extends ( ID | P_1 ) TAIL* )? B_c | import P_e | <import new> '.' WORD | '#' ID )",
    "U": "PRE* ( ATOM TAIL* <++ -->? | (?<= '=>' ) B_s )",
    "BIN": f"( {_alternatives(_JS_BINARY)} )",
    "E": "U ( BIN U )*",
    "TERNARY": "E",
    "SEQ": "E ( ',' E )*",
    "P_e": "( '...'? E ( ',' '...'? E )* ','? )?",
    "P_1": "SEQ",
    "P_p": "( '...'? ( ID | S_a | B_o ) ( '=' E )? ( ',' '...'? ( ID | S_a | B_o ) ( '=' E )? )* ','? )?",
    "BIND": "( ID | S_a | B_o ) ( '=' E )?",
    "DECL": "<var let const> BIND ( ',' BIND )*",
    "P_f": "( DECL | SEQ )? ';' SEQ? ';' SEQ? | <var let const>? ( ID | S_a | B_o | U ) <of in> SEQ",
    "S_a": "','* ( '...'? E ( ','+ '...'? E )* ','* )?",
    "PROP": "( KEY ':' E | ID ( '=' E )? | <true false null this>  | '...' E | ( async? '*'? | <get set> ) KEY P_p B_s )",
    "B_o": "( PROP ( ',' PROP )* ','? )?",
    "END": "( ';' | NL | EOS )",
    "FUN": "async? function '*'? ID P_p B_s",
    "CLS": "class ID ( extends U )? B_c",
    "IF": "if P_1 NL?",
    "LOOP": "( ( for await? P_f | while P_1 | with P_1 | ID ':' ) NL? | do NL? )",
    "CORE": "( ';' | B_s | FUN | CLS | DECL END | (?! <function class> | B_o ) SEQ END | return SEQ? END | throw SEQ END | <break continue> ID? END | debugger END | try B_s NL? ( catch P_p? B_s NL? ( finally B_s )? | finally B_s ) | switch P_1 B_w | ';' )",
    "STMT": "(?> LOOP* CORE | while P_1 END | LOOP* IF ( IF | LOOP )* CORE ( NL? else NL? ( IF | LOOP )* CORE )* )",
    "STEP": "( DECL | (?! <function class> | B_o ) SEQ | return SEQ? | throw SEQ | <break continue> ID? )",
    "LEAD": "( IF | LOOP | else )*",
    "STMTS": "( STMT | NL )*",
    "B_s": "STMTS",
    "B_c": "( ';' | NL | static B_s | static? ( async? '*'? | <get set> ) KEY P_p B_s | static? KEY ( '=' E )? END )*",
    "B_w": "( <case> SEQ ':' STMTS | default ':' STMTS )*",
    "B_i": "( ( WORD | LIT ) ( as ( WORD | LIT ) )? ( ',' ( WORD | LIT ) ( as ( WORD | LIT ) )? )* ','? )?",
    "ITEM": "( import LIT END | import ( ID | '*' as ID | B_i ) ( ',' ( '*' as ID | B_i ) )? from LIT ( with B_o )? END | export default ( async? function '*'? ID? P_p B_s | class ID? ( extends U )? B_c | E END ) | export ( DECL END | FUN | CLS ) | export ( B_i | '*' ( as WORD )? ) ( from LIT )? END )",
    "TOP": "( ITEM | STMT | NL )*",
}


def _javascript() -> Grammar:
    return Grammar(
        words="break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum",
        soft="let static async await yield of get set from as", signs=_JS_SIGNS, rules=_JS,
        ends="i let static async await yield of get set from as LIT TICK ) ] } this super null true false break continue return debugger ++ --",
        not_before=_CONTINUES + " in instanceof catch finally extends *= /= << >> >>>")


_TS_MODS = "<public private protected static readonly abstract override declare async accessor>*"
_TS_TYPE = {
    "TATOM": "( ( ID | <void null this typeof true false> ) ( '.' ID )* GEN | typeof ID ( '.' ID )* GEN | LIT | '-' LIT | P_y | B_t | B_o | S_t | TICK | typeof? import P_e ( '.' ID )* GEN )",
    "TPRE": "( <keyof readonly infer unique asserts abstract new> | GEN P_p '=>' )",
    "TYPE": "<| &>? TPRE* TATOM ( S_i | S_t )* ( ( <| & extends is> | TERN ) TPRE* TATOM ( S_i | S_t )* )*",
    "OFTYPE": "( '?:' TYPE | <? !>? ( ':' TYPE )? )",
}
_TS_E = {
    "KEY": "( WORD | LIT | S_a | '#' WORD )",
    "PRE": "( <typeof void delete await yield new ! ~ + - ++ --> | yield '*' | async? ( ID | GEN P_p ( ':' TYPE )? ) '=>' )",
    "TAIL": "( <. ?.> '#'? WORD | GEN ( '?.'? P_e | TICK ) | GEN1 | '?.'? S_a | '!' | TICK )",
    "ATOM": "( ID | LIT | <this super null true false> | P_1 | S_a | B_o | async? function '*'? ID? GEN P_p ( ':' TYPE )? B_s | class ID? GEN ( extends ( ID | P_1 ) TAIL* )? B_c | import P_e | <import new> '.' WORD | '#' ID | GEN1 U0? )",
    "U": "PRE* ( ATOM TAIL* <++ -->? ( <as satisfies> ( const | TYPE ) )* | (?<= '=>' ) B_s )",
    "BIN": f"( {_alternatives(_JS_BINARY.replace('>> >>>', '').replace('>>= >>>=', ''))} | '>' '>'+ '>='? )",
}
_TS_MEMBERS = {
    "FUN": "async? function '*'? ID GEN P_p ( ':' TYPE )? ( B_s | END )",
    "TYPES": "TYPE ( ',' TYPE )*",
    "CLS": "( '@' ID ( '.' ID )* P_e? NL? )* abstract? class ID GEN ( extends U )? ( implements TYPES )? B_c",
    "DECLARED": "( CLS | FUN | interface ID GEN ( extends TYPES )? B_t | type ID GEN '=' TYPE END | const? enum ID B_e | ( namespace | module ) ( ID ( '.' ID )* | LIT ) B_n | DECL END )",
}


def _typescript() -> Grammar:
    rules: dict[str, str] = {}
    rules |= _TS_TYPE
    rules |= {"KEY": _TS_E["KEY"], "PRE": _TS_E["PRE"], "TAIL": _TS_E["TAIL"], "ATOM": _TS_E["ATOM"].replace(" | GEN1 U0?", ""), "U": _TS_E["U"], "BIN": _TS_E["BIN"]}
    rules |= {k: _JS[k] for k in ("E", "SEQ", "P_e", "P_1")}
    rules |= {
        "TERNARY": "( E | TYPE )",
        "PARAM": "( '@' ID P_e? )* <public private protected readonly override>* '...'? ( ID | this | S_a | B_o ) OFTYPE ( '=' E )?",
        "P_p": "( PARAM ( ',' PARAM )* ','? )?",
        "P_y": "TYPE",
        "BIND": "( ID | S_a | B_o ) OFTYPE ( '=' E )?",
        "DECL": "<var let const> BIND ( ',' BIND )*",
        "P_f": _JS["P_f"], "S_a": _JS["S_a"],
        "S_t": "( ( '...'? ( ID <?>? ':' | ID '?:' )? '...'? TYPE '?'? ( ',' '...'? ( ID <?>? ':' | ID '?:' )? '...'? TYPE '?'? )* ','? )? )",
        "S_i": "TYPE?",
        "S_x": "ID ':' TYPE | ID in TYPE ( as TYPE )?",
        "PROP": "( KEY ':' E | ID ( '=' E )? | <true false null this> | '...' E | ( async? '*'? | <get set> ) KEY GEN P_p ( ':' TYPE )? B_s )",
        "B_o": _JS["B_o"], "END": _JS["END"], **_TS_MEMBERS, "IF": _JS["IF"], "LOOP": _JS["LOOP"],
        "CORE": _JS["CORE"].replace("catch P_p?", "catch P_p?").replace("FUN | CLS | DECL END", "DECLARED"),
        "STEP": _JS["STEP"], "LEAD": _JS["LEAD"], "STMT": _JS["STMT"], "STMTS": _JS["STMTS"], "B_s": "STMTS",
        "B_c": f"( ';' | NL | static B_s | ( '@' ID ( '.' ID )* P_e? NL? )* {_TS_MODS} ( '*' | <get set> )? KEY '?'? GEN P_p ( ':' TYPE )? ( B_s | END ) | ( '@' ID ( '.' ID )* P_e? NL? )* {_TS_MODS} KEY OFTYPE ( '=' E )? END | {_TS_MODS} S_x ':' TYPE END )*",
        "B_w": _JS["B_w"], "B_i": "( type? ( WORD | LIT ) ( as ( WORD | LIT ) )? ( ',' type? ( WORD | LIT ) ( as ( WORD | LIT ) )? )* ','? )?",
        "TMEMBER": "( <readonly get set + ->* ( S_x | KEY ) ( '?:' TYPE | <? - +>* ( GEN P_p )? ( ':' TYPE )? ) | <+ ->? readonly? S_x <+ ->? ( '?:' | '?'? ':' ) TYPE | new? GEN P_p ( ':' TYPE )? )",
        "B_t": "( <; ,> | NL )* ( TMEMBER ( <; ,> | NL )+ )* TMEMBER?",
        "B_e": "( NL? KEY ( '=' E )? ( ',' NL? KEY ( '=' E )? )* ','? NL? )?",
        "ITEM": "( import LIT END | import type? ( ID | '*' as ID | B_i ) ( ',' ( '*' as ID | B_i ) )? from LIT ( with B_o )? END | import ID '=' U END | export default ( async? function '*'? ID? GEN P_p ( ':' TYPE )? B_s | abstract? class ID? GEN ( extends U )? ( implements TYPES )? B_c | interface ID GEN ( extends TYPES )? B_t | E END ) | export? declare ( DECLARED | global B_n ) | ( '@' ID ( '.' ID )* P_e? NL? )* export ( default )? DECLARED | export type? ( B_i | '*' ( as WORD )? ) ( from LIT )? END | export '=' E END | export as namespace ID END )",
        "B_n": "( ITEM | STMT | NL )*",
        "TOP": "( ITEM | STMT | NL )*",
    }
    return Grammar(
        words="break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum",
        soft="let static async await yield of get set from as type interface namespace module declare abstract private public protected readonly override implements keyof infer is asserts satisfies unique global accessor", signs="?: " + " ".join(x for x in _JS_SIGNS.split() if x[:2] != ">>"), rules=rules,
        ends="i let static async await yield of get set from as type interface namespace module declare abstract private public protected readonly override implements keyof infer is asserts satisfies unique global accessor LIT TICK ) ] } > this super null true false void break continue return debugger ++ -- !",
        wider="B_n", not_before=_CONTINUES + " ?: in instanceof catch finally extends implements is < > <<", generic="i GRP LIT TICK . , | & - = => \x0f extends keyof typeof infer readonly void null this true false unique in " + "let static async await yield of get set from as type interface namespace module declare abstract private public protected readonly override implements keyof infer is asserts satisfies unique global accessor")


_C_SIGNS = "... :: -> ++ -- == != <= >= && || += -= *= /= %= &= |= ^= <<= <<"
_C_BINARY = "== != <= >= && || += -= *= /= %= &= |= ^= <<= << = + - * / % & | ^ TERN <"
_C_FLOW = {
    "P_1": "E",
    "LOOP": "( ID ':' | for P_f | while P_1 | do )",
    "IF": "if P_1",
    "LEAD": "( IF | LOOP | else )*",
    "STMT": "(?> LOOP* CORE | LOOP* IF ( IF | LOOP )* CORE ( else ( IF | LOOP )* CORE )* )",
    "B_s": "STMT*",
}


def _java() -> Grammar:
    rules = {
        "ANN": "'@' ID ( '.' ID )* P_a?",
        "MOD": "( <public private protected static final abstract native synchronized transient volatile strictfp default sealed> | non '-' sealed | ANN )*",
        "TYPE": "ANN* ID GEN ( '.' ANN* ID GEN )* S_0*",
        "TYPES": "TYPE ( ',' TYPE )*",
        "MADE": "new ANN* ID GEN ( '.' ID GEN )* ( P_e B_c? | ( S_e | S_0 )+ B_a? )",
        "PRE": "( <! ~ + - ++ --> | P_c | ( ID | P_p | P_l ) '->' )",
        "ATOM": "( MADE | ID | LIT | <this super null true false> | P_1 | switch P_1 B_w )",
        "TAIL": "( '.' GEN ( ID | <class this super> ) | '.' MADE | P_e | S_e | S_0 | '::' GEN ( ID | new ) | GEN1 (?= '::' ) )",
        "U": "PRE* ( ATOM TAIL* <++ -->? | (?<= '->' ) B_s )",
        "BIN": f"( {_alternatives(_C_BINARY)} | '>' '>'* '>='? )",
        "E": "U ( BIN U | instanceof MOD TYPE ( ID | P_r )? )*",
        "TERNARY": "E",
        "P_a": "( ( ID '=' )? ( E | B_a | ANN ) ( ',' ( ID '=' )? ( E | B_a | ANN ) )* )?",
        "P_e": "( E ( ',' E )* )?",
        "P_c": "TYPE ( '&' TYPE )*",
        "P_l": "ID ( ',' ID )*",
        "PARAM": "MOD TYPE '...'? ( ID | this ) S_0*",
        "P_p": "( PARAM ( ',' PARAM )* )?",
        "P_r": "( ( TYPE ( ID | P_r ) | ID ) ( ',' ( TYPE ( ID | P_r ) | ID ) )* )?",
        "VARS": "ID S_0* ( '=' ( E | B_a ) )? ( ',' ID S_0* ( '=' ( E | B_a ) )? )*",
        "P_f": "( MOD TYPE VARS | E ( ',' E )* )? ';' E? ';' ( E ( ',' E )* )? | MOD TYPE ID ':' E",
        "P_t": "( MOD TYPE ID '=' E | U ) ( ';' ( MOD TYPE ID '=' E | U ) )* ';'?",
        "P_k": "MOD TYPE ( '|' TYPE )* ID",
        "S_0": "", "S_e": "E",
        "B_a": "( ( E | B_a | ANN ) ( ',' ( E | B_a | ANN ) )* )? ','?",
        "TYPEDECL": "( class ID GEN ( extends TYPE )? ( implements TYPES )? ( permits TYPES )? B_c | interface ID GEN ( extends TYPES )? ( permits TYPES )? B_c | '@' interface ID B_c | enum ID ( implements TYPES )? B_e | record ID GEN P_p ( implements TYPES )? B_c )",
        "CORE": "( ';' | B_s | MOD TYPEDECL | MOD TYPE VARS ';' | E ';' | return E? ';' | throw E ';' | <break continue> ID? ';' | yield E ';' | assert E ( ':' E )? ';' | synchronized P_1 B_s | try ( P_t B_s ( catch P_k B_s )* ( finally B_s )? | B_s ( ( catch P_k B_s )+ ( finally B_s )? | finally B_s ) ) | switch P_1 B_w | ';' )",
        "STEP": "( MOD TYPE VARS | E | return E? | throw E | <break continue> ID? | yield E )",
        **_C_FLOW,
        "LABEL": "( E | TYPE ( ID | P_r ) ( when E )? | default )",
        "B_w": "( ( case LABEL ( ',' LABEL )* | default ) ( ':' STMT* | '->' ( E ';' | B_s | throw E ';' ) ) )*",
        "MEMBER": "(?> ';' | static? B_s | MOD TYPEDECL | MOD GEN ID P_p ( throws TYPES )? B_s | MOD ID B_s | MOD GEN TYPE ID P_p S_0* ( throws TYPES )? ( B_s | default ( E | B_a | ANN ) ';' | ';' ) | MOD TYPE VARS ';' )",
        "B_c": "MEMBER*",
        "B_e": "( ANN* ID P_e? B_c? ( ',' ANN* ID P_e? B_c? )* )? ','? ( ';' MEMBER* )?",
        "B_m": "( ( ID | <default> ) ANY* ';' )*",
        "TOP": "( ANN* package ID ( '.' ID )* ';' )? ( import static? ID ( '.' ID )* ( '.' '*' )? ';' | ';' )* ( MOD TYPEDECL | ';' | ANN* ID? module ID ( '.' ID )* B_m )*",
    }
    return Grammar(
        words="abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try volatile while null true false",
        soft="record sealed permits yield non module when", signs=_C_SIGNS, rules=rules, closed=True, generic="i record sealed permits yield non module when . , ? & extends super @ GRP \x0f")


def _csharp() -> Grammar:
    soft = "var record yield when where get set init add remove async await partial dynamic from select join let group into orderby on equals by ascending descending value nameof global required file and or not unmanaged with scoped"
    rules = {
        "ATTR": "S_t*",
        "MOD": "( S_t | <public private protected internal static sealed abstract virtual override readonly const async partial extern unsafe new volatile ref required file fixed scoped> )*",
        "T0": "( ( ID ( '::' ID )? GEN ( '.' ID GEN )* | P_y ) )",
        "TYPE": "ref? readonly? T0 ( '?' | '*' | S_0 )*",
        "TYPES": "TYPE ( ',' TYPE )*",
        "PRE": "( <! ~ + - ++ -- & * ^ await ref> | P_c | <throw> | static? async? static? ( ID | P_p | P_l ) '=>' )",
        "MADE": "( new ( TYPE ( P_e B_o? | B_o | S_e S_0* B_o? | B_o ) | P_e B_o? | S_0 B_o | B_o ) | stackalloc TYPE S_e B_o? )",
        "ATOM": "( MADE | ID ( '::' ID )? | STR+ | LIT | <this base null true false default> | P_1 | P_u | <typeof sizeof checked unchecked default> P_c | <checked unchecked> P_1 | async? delegate P_p? B_s | S_e )",
        "TAIL": "( '?'? '.' ID GEN | '->' ID | P_e | '?'? S_e | '!' | GEN (?= <. ,> | P_e ) | with B_o )",
        "PAT0": "( not )* ( ( '<' | '>' | '<=' | '>=' ) U | TYPE? P_t? B_p ID? | TYPE P_t? ID? | null | U | P_t ID? | S_e | var ID )",
        "PAT": "PAT0 ( <and or> PAT0 )*",
        "SWITCH": "switch B_x",
        "U": "PRE* ( ATOM TAIL* <++ -->? ( '..' ( ATOM TAIL* )? )? | '..' ( ATOM TAIL* )? | (?<= '=>' ) B_s )",
        "BIN": f"( {_alternatives(_C_BINARY)} | '??' | '??=' | '>' '>'* '>='? )",
        "E0": "U ( BIN U | is PAT | as TYPE | SWITCH )*",
        "E": "( from TYPE? ID in E0 ( from TYPE? ID in E0 | where E0 | let ID '=' E0 | orderby E0 <ascending descending>? ( ',' E0 <ascending descending>? )* | join ID in E0 on E0 equals E0 ( into ID )? | select E0 | group E0 by E0 ( into ID )? )+ | E0 )",
        "TERNARY": "E0",
        "ARG": "( ID ':' )? ( <out ref in>? ( TYPE ID | E ) )",
        "P_e": "( ARG ( ',' ARG )* )?",
        "P_1": "E",
        "P_u": "( ID ':' )? ( E | TYPE ID ) ( ',' ( ID ':' )? ( E | TYPE ID ) )+",
        "P_y": "TYPE ID? ( ',' TYPE ID? )+",
        "P_c": "TYPE | ID ','+",
        "P_l": "( ID ( ',' ID )* )?",
        "PARAM": "ATTR <this ref out in params scoped readonly>* TYPE ID ( '=' E )?",
        "P_p": "( PARAM ( ',' PARAM )* )?",
        "P_t": "( ( ID ':' )? PAT ( ',' ( ID ':' )? PAT )* )?",
        "VARS": "ID ( '=' ( E | B_o ) )? ( ',' ID ( '=' ( E | B_o ) )? )*",
        "P_f": "( TYPE VARS | E ( ',' E )* )? ';' E? ';' ( E ( ',' E )* )? | ( TYPE ID | var? P_l | P_u | P_y ) in E",
        "P_v": "TYPE VARS | E",
        "S_0": "','*", "S_e": "( ( '..'? E | ID ':' E ) ( ',' '..'? E )* )? ','?",
        "S_t": "( ID ':' )? ID ( '.' ID )* GEN P_e? ( ',' ID ( '.' ID )* GEN P_e? )* ','?",
        "S_p": "PARAM ( ',' PARAM )*",
        "B_o": "( ( ( ID | S_e ) '=' )? ( E | B_o ) ( ',' ( ( ID | S_e ) '=' )? ( E | B_o ) )* ','? )?",
        "B_p": "( ID ( '.' ID )* ':' PAT ( ',' ID ( '.' ID )* ':' PAT )* ','? )?",
        "B_x": "( PAT ( when E )? '=>' E ( ',' PAT ( when E )? '=>' E )* ','? )?",
        "WHERE": "( where ID ':' ( TYPE | class '?'? | struct | new P_e | default | notnull ) ( ',' ( TYPE | class | struct | new P_e ) )* )*".replace(" | notnull", ""),
        "TYPEDECL": "( ( class | struct | interface | record ( class | struct )? ) ID GEN P_p? ( ':' TYPE P_e? ( ',' TYPE )* )? WHERE ( B_c ';'? | ';' ) | enum ID ( ':' TYPE )? B_e ';'? | delegate TYPE ID GEN P_p WHERE ';' )",
        "LOCAL": "( static | async | unsafe | S_t )* TYPE ID GEN P_p WHERE ( B_s | '=>' E ';' )",
        "CORE": "( ';' | B_s | LOCAL | <const using await ref readonly>* TYPE VARS ';' | E ';' | return E? ';' | throw E? ';' | yield ( return E | break ) ';' | <break continue> ';' | goto ( ID | case E | default ) ';' | <checked unchecked unsafe> B_s | try B_s ( ( catch ( P_c | P_p )? ( when P_1 )? B_s )+ ( finally B_s )? | finally B_s ) | switch ( P_1 | P_u ) B_w | ';' )",
        "STEP": "( <const using await ref readonly>* TYPE VARS | E | return E? | throw E? | yield ( return E | break ) | <break continue> )",
        **_C_FLOW,
        "LOOP": "( ID ':' | for P_f | await? foreach P_f | while P_1 | do | lock P_1 | <using fixed> P_v )",
        "B_w": "( ( case PAT ( when E )? | default ) ':' STMT* )*",
        "ACCESS": "( ATTR <public private protected internal readonly>* <get set init add remove> ( B_s | '=>' E ';' | ';' ) )",
        "MEMBER": "(?> ';' | MOD TYPEDECL | MOD '~'? ID P_p ( ':' <this base> P_e )? ( B_s | '=>' E ';' | ';' ) | MOD event TYPE ( ID ( '.' ID )* B_q | VARS ';' ) | MOD <implicit explicit> operator TYPE P_p ( B_s | '=>' E ';' ) | MOD TYPE ( ID GEN '.' )* ( ID GEN P_p WHERE | operator_ P_p ) ( B_s | '=>' E ';' | ';' ) | MOD TYPE ( ID GEN '.' )* ( ID | this S_p ) ( B_q ( '=' ( E | B_o ) ';' )? | '=>' E ';' ) | MOD TYPE VARS ';' )",
        "B_c": "MEMBER*",
        "B_q": "ACCESS+",
        "B_e": "( ATTR ID ( '=' E )? ( ',' ATTR ID ( '=' E )? )* )? ','?",
        "USING": "global? using static? ( ID '=' )? TYPE ';'",
        "SPACE": "namespace ID ( '.' ID )* ( B_n ';'? | ';' )",
        "UNIT": "( extern ID ID ';' | USING | SPACE | MOD TYPEDECL | S_t )",
        "B_n": "UNIT*",
        "TOP": "( UNIT | STMT )*",
    }
    words = "abstract as base break case catch checked class const continue default delegate do else enum event explicit extern finally fixed for foreach goto if implicit in interface internal is lock namespace new null operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch this throw true false try typeof unchecked unsafe using virtual volatile while operator_"
    return Grammar(words=words, soft=soft, signs="... ?? ??= => .. " + _C_SIGNS.replace("... ", ""), rules=rules, closed=True, generic=f"i {soft} . , ? * :: in out GRP \x0f",
                   before=((f"operator ( {_alternatives('++ -- == != <= >= << + - * / % & | ^ ! ~ true false <')} | '>' '>'? )", "operator_"),))


def _dart() -> Grammar:
    soft = "as? ".replace("as? ", "") + "abstract async await base covariant deferred dynamic export extension external factory get hide implements import interface late library mixin of on operator part required sealed set show static sync typedef yield when record Function"
    rules = {
        "ANN": "'@' ID ( '.' ID )* P_e?",
        "FN": "Function GEN P_g '?'?",
        "TYPE": "( ( ID ( '.' ID )? GEN | void | P_y ) '?'? FN* | FN+ )",
        "TYPES": "TYPE ( ',' TYPE )*",
        "PRE": "( <! ~ - ++ -- await throw> )",
        "LAMBDA": "GEN P_p ( async '*'? | sync '*' )? ( B_s | '=>' EC )",
        "ATOM": "( <new const>? ID GEN | STR+ | LIT | <this super null true false> | P_1 | P_u | const? GEN ( S_e | B_o ) | switch P_1 B_x )",
        "TAIL": "( <. ?.> ( ID | new ) GEN | '..' | P_e | '?'? S_e | '!' )",
        "CASCADE": "( <.. ?..> ( ID GEN | S_e ) TAIL* ( <= += -= *= /= ??=> E )? )",
        "U": "PRE* ( LAMBDA | ATOM TAIL* <++ -->? CASCADE* )",
        "BIN": f"( {_alternatives(_C_BINARY)} | '??' | '??=' | '~/' | '~/=' | '>' '>'* '>='? )",
        "EC": "U ( BIN U | is '!'? TYPE | as TYPE )*",
        "E": "EC",
        "TERNARY": "E",
        "P_1": "E",
        "P_e": "( ( ID ':' )? E ( ',' ( ID ':' )? E )* ','? )?",
        "P_u": "( ID ':' )? E ( ',' ( ( ID ':' )? E )? )+ | ID ':' E",
        "P_y": "TYPE ID? ( ',' TYPE ID? )+ ','? | B_y",
        "B_y": "TYPE ID ( ',' TYPE ID )* ','?",
        "PARAM": "ANN* <required covariant final late const>* var? ( ( TYPE ? ( <this super> '.' )? ID ) GEN ( P_p '?'? )? ) ( <= :> E )?".replace("TYPE ?", "TYPE?"),
        "PLIST": "PARAM ( ',' PARAM )*",
        "P_p": "( PLIST ( ',' ( B_p | S_p ) )? ','? | B_p | S_p )?",
        "B_p": "PLIST ','?", "S_p": "PLIST ','?",
        "GTYPE": "required? TYPE ID?",
        "P_g": "( GTYPE ( ',' GTYPE )* ( ',' ( B_g | S_g ) )? ','? | B_g | S_g )?",
        "B_g": "GTYPE ( ',' GTYPE )* ','?", "S_g": "GTYPE ( ',' GTYPE )* ','?",
        "VARS": "ID ( '=' E )? ( ',' ID ( '=' E )? )*",
        "DECL": "( late? ( final | const ) TYPE? VARS | late? ( var | TYPE ) VARS | ( var | final ) ( P_u | P_y | S_e | B_o ) '=' E )",
        "P_f": "( DECL | E ( ',' E )* )? ';' E? ';' ( E ( ',' E )* )? | ( <final var> TYPE? | TYPE )? ID in E",
        "P_k": "ID ( ',' ID )?",
        "ELEM": "( ( if P_1 | await? for P_f | else )* ( ( '...' | '...?' ) )? E ( ':' E )? )",
        "S_e": "( ELEM ( ( ',' | (?= else ) ) ELEM )* ','? )?",
        "B_o": "( ELEM ( ( ',' | (?= else ) ) ELEM )* ','? )?",
        "PAT": "( E | TYPE ID | <var final> TYPE? ID | ANYPAT )".replace(" | ANYPAT", ""),
        "B_x": "( PAT ( when E )? '=>' E ( ',' PAT ( when E )? '=>' E )* ','? )?",
        "FBODY": "( ( async '*'? | sync '*' )? ( B_s | '=>' E ';' ) )",
        "FUN": "external? ( TYPE )? ( ID GEN P_p | get ID | set ID P_p ) ( FBODY | ';' )",
        "LOCAL": "TYPE? ID GEN P_p FBODY",
        "CORE": "( ';' | B_s | LOCAL | DECL ';' | E ';' | return E? ';' | rethrow ';' | <break continue> ID? ';' | yield '*'? E ';' | assert P_e ';' | try B_s ( ( catch P_k B_s | on TYPE ( catch P_k )? B_s )+ ( finally B_s )? | finally B_s ) | switch P_1 B_w | ';' )",
        "STEP": "( DECL | E | return E? | rethrow | <break continue> ID? | yield '*'? E | assert P_e )",
        **_C_FLOW,
        "IF": "if ( P_1 | P_m )",
        "P_m": "E case PAT ( when E )?",
        "LOOP": "( ID ':' | await? for P_f | while P_1 | do )",
        "B_w": "( ( ( ID ':' )? case PAT ( when E )? | default ) ':' STMT* )*",
        "CTOR": "<const external factory>* ID ( '.' ( ID | new ) )? P_p ( ':' ( <this super> ( '.' ( ID | new ) )? ( P_e | '=' E ) | ID '=' E | assert P_e ) ( ',' ( <this super> ( '.' ( ID | new ) )? ( P_e | '=' E ) | ID '=' E | assert P_e ) )* )? ( ';' | FBODY | '=' TYPE ( '.' ID )? ';' )",
        "MEMBER": "(?> ANN* ( CTOR | <static external abstract covariant>* ( FUN | TYPE? operator_ P_p ( FBODY | ';' ) | late? ( final | const ) TYPE? VARS ';' | late? ( var | TYPE ) VARS ';' ) ) )",
        "B_c": "MEMBER*",
        "B_e": "( ANN* ID GEN ( '.' ID )? P_e? ( ',' ANN* ID GEN ( '.' ID )? P_e? )* )? ','? ( ';' MEMBER* )?",
        "CLS": "( <abstract base final interface sealed mixin>* class ID GEN ( extends TYPE )? ( with TYPES )? ( implements TYPES )? B_c | <abstract base final interface sealed mixin>* class ID GEN '=' TYPE with TYPES ( implements TYPES )? ';' | base? mixin ID GEN ( on TYPES )? ( implements TYPES )? B_c | extension ID? GEN on TYPE B_c | extension ID ID GEN P_p ( implements TYPES )? B_c | enum ID GEN ( with TYPES )? ( implements TYPES )? B_e | typedef ID GEN '=' TYPE ';' | typedef TYPE? ID GEN P_g ';' | typedef TYPE? ID GEN P_p ';' )",
        "TOP": "( library ( ID ( '.' ID )* )? ';' | ANN* ( import | export ) LIT ( deferred )? ( as ID )? ( <show hide> ID ( ',' ID )* )* ';' | ANN* part of? ( LIT | ID ( '.' ID )* ) ';' )* (?> ANN* ( CLS | FUN | ( late? ( final | const ) TYPE? | late? ( var | TYPE ) ) VARS ';' ) )*",
    }
    words = "assert break case catch class const continue default do else enum extends final finally for if in is new null rethrow return super switch this throw true false try var void while with as operator_"
    return Grammar(words=words, soft=soft, signs="...? ... ?.. ?. .. => ++ -- == != <= >= && || ?? ??= ~/ ~/= += -= *= /= %= &= |= ^= <<= <<", rules=rules, closed=True, generic=f"i {soft} . , ? void extends GRP \x0f",
                   before=((f"operator ( {_alternatives('== <= >= << ~/ + - * / % & | ^ ~ <')} | '>' '>'? '>'? | '[' ']' '='? )", "operator_"),))


def _cpp() -> Grammar:
    soft = "final override import module"
    spec = "const constexpr consteval constinit static inline volatile mutable extern virtual explicit friend typename unsigned signed long short auto register thread_local struct class enum union typedef"
    rules = {
        "ATTR": "S_e*",
        "NAME": "'::'? ( ID GEN | operator_ ) ( '::' template? ( '~'? ID GEN | operator_ ) )*",
        "SPEC": f"<{spec}>",
        "TYPE": "( ATTR SPEC* ( NAME | decltype P_e ) ( SPEC | '&' (?= const ) )* | SPEC+ )",
        "PTR": "( '*' | '&' | '&&' | const | volatile )*",
        "PRE": "( <! ~ + - ++ -- * & && sizeof co_await co_yield throw> | P_c | delete S_e? )",
        "ATOM": "( new P_e? TYPE PTR S_e* ( P_e | B_i )? | S_e GEN P_p? <mutable constexpr noexcept>* ( '->' TYPE PTR )? B_s | NAME B_i? | STR+ | LIT | <this nullptr true false> | P_1 | SPEC+ ( P_e | B_i ) | decltype P_e B_i? | sizeof '...' P_e | B_i | <sizeof alignof noexcept typeid> P_e | throw | requires P_p? B_s )",
        "TAIL": "( <. ->> template? '~'? NAME | '->' template? '~'? NAME | P_e B_i? | S_e | '...' )".replace("<. ->> template? '~'? NAME | ", "'.' template? '~'? NAME | "),
        "U": "PRE* ATOM TAIL* <++ -->?",
        "BIN": f"( {_alternatives(_C_BINARY)} | '<=>' | '.*' | '->*' | <and or xor bitand bitor not_eq> | '>' '>'* '>='? )",
        "E": "U ( BIN U )*",
        "TERNARY": "E",
        "ARG": "( E | TYPE PTR ( P_p )? )",
        "P_1": "( '...' BIN )? E ( ',' E )* ( BIN '...' ( BIN E )? )?",
        "P_e": "( ARG '...'? ( ',' ARG '...'? )* )?",
        "P_c": "TYPE PTR ( P_d P_p )? S_e*",
        "P_d": "( NAME '::' )? ( '*' | '&' | '&&' )+ const? NAME? S_e* P_p?",
        "PARAM": "( TYPE ATTR PTR '...'? ( NAME S_e* | P_d ( P_p | S_e )? | P_p )? S_e* ( '=' ( E | B_i ) )? | '...' | this TYPE PTR NAME )",
        "P_p": "( PARAM ( ',' PARAM )* )?",
        "INIT": "( '=' ( E | B_i ) | P_e | B_i | ':' ( LIT | NAME | P_1 ) ( '=' E | B_i )? )",
        "DECLR": "PTR ( NAME S_e* | P_d ( P_p | S_e )? ) ATTR INIT?",
        "VARS": "DECLR ( ',' DECLR )*",
        "DECL": "( TYPE VARS | <const static constexpr>* auto <const & &&>* S_e '=' E | <const static constexpr>* auto <const & &&>* S_e ( B_i | P_e ) )",
        "P_f": "( DECL | E ( ',' E )* )? ';' E? ';' ( E ( ',' E )* )? | ( DECL ';' )? ( TYPE PTR ( NAME | S_e ) ) ':' ( E | B_i )",
        "P_v": "( ( DECL | E ) ';' )? ( E | TYPE PTR NAME ( '=' ( E | B_i ) | B_i ) )",
        "P_k": "TYPE PTR NAME? | '...'",
        "S_e": "( '&' | '=' | E | B_i | '&' ID | ID ':' )? ( ',' ( '&'? ( E | '=' | '...' ) ) )* '...'? | S_e | '*' this ( ',' E )*",
        "B_i": "( ( '.' ID ( '=' E | B_i ) | ( S_e '=' )? ( E | B_i ) '...'? ) ( ',' ( '.' ID ( '=' E | B_i ) | ( S_e '=' )? ( E | B_i ) '...'? ) )* )? ','?",
        "B_e": "( ID ATTR ( '=' E )? ( ',' ID ATTR ( '=' E )? )* )? ','?",
        "TMPL": "( template GEN1 ( requires ( E ) )? )*",
        "QUAL": "( <const volatile override final & &&> | noexcept P_e? | ATTR | throw P_e | requires E )*".replace(" | ATTR", ""),
        "BODY": "( QUAL ( '->' TYPE PTR )? ( requires E )? ( ( ':' NAME ( P_e | B_i ) '...'? ( ',' NAME ( P_e | B_i ) '...'? )* )? B_s | ';' | '=' ( LIT | default | delete ) ';' | try B_s ( catch P_k B_s )+ ) )",
        "BASES": "':' <public private protected virtual>* NAME '...'? ( ',' <public private protected virtual>* NAME '...'? )*",
        "CLS": "(?= <typedef static const constexpr inline friend class struct union> ) <typedef static const constexpr inline friend>* ( class | struct | union ) ATTR ( NAME final? )? ( BASES )? B_c VARS? ';'",
        "ENUM": "(?= <typedef static const enum> ) <typedef static const>* enum ( class | struct )? NAME? ( ':' TYPE )? ( B_e VARS? )? ';'",
        "FUN": "TMPL ATTR ( TYPE PTR )? '~'? NAME P_p BODY | TMPL SPEC* operator TYPE PTR P_p BODY | TMPL SPEC* P_p".replace(" | TMPL SPEC* P_p", ""),
        "SMALL": "(?= <using static_assert friend template class struct namespace asm> ) ( using ( namespace NAME | ID ATTR '=' TYPE PTR ( P_p | S_e | P_d P_p )* | enum? typename? NAME ( ',' NAME )* ) ';' | static_assert P_e ';' | friend ( class | struct )? TYPE ';' | TMPL ( class | struct ) NAME ';' | template ( class | struct )? TYPE ';' | namespace ID '=' NAME ';' | asm P_e ';' | TMPL concept ID '=' E ';' | TMPL using ID '=' TYPE PTR ( P_p )? ';' )",
        "CORE": "( ';' | B_s | CLS | ENUM | SMALL | DECL ';' | E ( ',' E )* ';' | return ( E | B_i )? ';' | co_return E? ';' | <break continue> ';' | goto ID ';' | try B_s ( catch P_k B_s )+ | switch P_v B_w | ATTR ';' )",
        "STEP": "( DECL | E ( ',' E )* | return E? | co_return E? | <break continue> )",
        "LEAD": "( IF | LOOP | else )*",
        "LOOP": "( ID ':' | for co_await? P_f | while P_v | do | S_e )",
        "IF": "if ( constexpr | consteval | '!' )* P_v?",
        "STMT": "(?> LOOP* CORE | LOOP* IF ( IF | LOOP )* CORE ( else ( IF | LOOP )* CORE )* )",
        "B_s": "STMT*",
        "B_w": "(?= case | default | EOS ) ( ( case E ( '...' E )? | default ) ':' | STMT )*",
        "MEMBER": "(?> ';' | <public private protected> ID? ':' | TMPL CLS | ENUM | SMALL | FUN | TMPL DECL ';' | ID P_e )",
        "B_c": "(?! ALL* <return if for while switch do break continue> ) MEMBER*",
        "UNIT": "(?> ';' | inline? namespace ATTR ( NAME ( '::' inline? NAME )* )? B_n ';'? | extern LIT ( B_n | UNIT0 ) | TMPL CLS | ENUM | SMALL | FUN | TMPL DECL ';' | ID P_e ';'? | export? <import module> ( NAME ( '.' NAME )* | ANY* )? ';' )".replace(" | UNIT0", " | FUN | DECL ';'"),
        "B_n": "(?! ALL* <return if for while switch do break continue> ) UNIT*",
        "TOP": "UNIT*",
    }
    words = spec + " alignas alignof and asm bitand bitor xor not_eq or break case catch concept continue co_await co_return co_yield decltype default delete do else export false for goto if namespace new noexcept nullptr operator private protected public requires return sizeof static_assert switch template this throw true try typeid using while operator_"
    return Grammar(words=words, soft=soft, signs="<=> ->* .* " + _C_SIGNS, rules=rules, closed=True, generic=f"i {soft} {spec} :: , * & ... = LIT true false GRP \x0f",
                   before=((f"operator ( {_alternatives('<=> == != <= >= <<= << += -= *= /= %= &= |= ^= ++ -- -> && || , + - * / % & | ^ ! ~ = <')} | '>' '>'? '='? | '(' ')' | '[' ']' | new | delete | STR ID )", "operator_"),))


def _go() -> Grammar:
    rules = {
        "T": "( ';' | NL | EOS )",
        "TYPE": "( '*' | '<-' chan | chan '<-'? | S_e | map S_e | '~' )* ( ID ( '.' ID )? S_e? | func P_p RESULT? | struct B_t | interface B_i | P_y )",
        "RESULT": "( TYPE | P_p )",
        "P_y": "TYPE",
        "PRE": "( <! ~ + - * & ^> | '<-' )",
        "ATOM": "( ID | LIT | P_1 | func P_p RESULT? B_s | ( S_e | map S_e | '*' )+ ( ID ( '.' ID )? S_e? | struct B_t | interface B_i | func P_p RESULT? | map S_e TYPE | P_y ) | struct B_t | interface B_i | chan TYPE )",
        "TAIL": "( '.' ( ID | P_a ) | S_e | P_e | B_o )",
        "U": "PRE* ATOM TAIL*",
        "BIN": f"( {_alternatives('== != <= && || << >> &^ < > + - * / % & | ^ >=')} )",
        "E": "U ( BIN U )*",
        "ES": "E ( ',' E )*",
        "P_1": "E",
        "P_a": "type | TYPE",
        "P_e": "( ( E | TYPE ) ( ',' ( E | TYPE ) )* '...'? ','? )?",
        "P_p": "( ( ID '...'? TYPE | '...'? TYPE ) ( ',' ( ID '...'? TYPE | '...'? TYPE ) )* ','? )?",
        "S_e": "( '...' | ( E | TYPE ) ( ',' ( E | TYPE ) )* ','? | E? ':' E? ( ':' E )? )?",
        "S_p": "ID ( ',' ID )* TYPE ( '|' TYPE )* ( ',' ID ( ',' ID )* TYPE ( '|' TYPE )* )* ','?",
        "B_o": "( ( E ':' )? ( E | B_o ) ( ',' ( ( E | B_o ) ':' )? ( E | B_o ) )* ','? )?".replace("( ( E ':' )?", "( ( ( E | B_o ) ':' )?"),
        "SIMPLE": "( ES ( ( ':=' | '=' | <+= -= *= /= %= &= |= ^= <<= &^= >>=> ) ES | '++' | '--' | '<-' E )? )".replace("<+= -= *= /= %= &= |= ^= <<= &^= >>=>", _alternatives("+= -= *= /= %= &= |= ^= <<= &^= >>=")),
        "NAMES": "ID ( ',' ID )*",
        "VAR": "NAMES ( TYPE ( '=' ES )? | '=' ES )",
        "CON": "NAMES ( TYPE? '=' ES )?",
        "TYP": "ID S_p? '='? TYPE",
        "P_v": "NL? ( VAR T )*", "P_n": "NL? ( CON T )*", "P_t": "NL? ( TYP T )*",
        "DECL": "( var ( VAR | P_v ) | const ( CON | P_n ) | type ( TYP | P_t ) )",
        "STEP": "( SIMPLE | DECL | return ES? | <break continue goto> ID? | fallthrough | <go defer> E )",
        "LEAD": "( ID ':' NL? )*",
        "IF": "if ( SIMPLE? ';' )? E B_s",
        "STMT": "(?> ';' | NL | ( ID ':' NL? )* ( STEP T | B_s T | IF ( else IF )* ( else B_s )? T | for ( SIMPLE? ';' E? ';' SIMPLE? | ( ES <:= => )? range E | E )? B_s T | switch ( SIMPLE? ';' )? ( SIMPLE )? B_w T | select B_w T ) | NL | ';' )".replace("<:= =>", "( ':=' | '=' )"),
        "B_s": "STMT*",
        "B_w": "NL? ( ( case ( SIMPLE | TYPE ( ',' ( TYPE | E ) )* ) | default ) ':' STMT* )*",
        "B_t": "NL? ( ( NAMES TYPE | '*'? ID ( '.' ID )? S_e? ) STR? T )*",
        "B_i": "NL? ( ( ID P_p RESULT? | TYPE ( '|' TYPE )* ) T )*",
        "IMP": "( ID | '.' )? STR",
        "P_i": "NL? ( IMP T )*",
        "TOP": "NL? package ID T NL? ( import ( IMP | P_i ) T )* ( DECL T | func P_p? ID S_p? P_p RESULT? B_s? T | NL )*",
    }
    return Grammar(words="break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var", soft="",
                   signs="<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^", rules=rules, ends="i LIT ) ] } break continue fallthrough return ++ --", not_before="\x13", bare_heads=True)


def _rust() -> Grammar:
    soft = "self Self super crate union auto default macro_rules yield raw await async dyn"
    rules = {
        "ATTR": "( '#' '!'? S_m )*",
        "PATHT": "( GEN1 | '::'? ID GEN ( P_y ( '->' TYPE )? )? ) ( '::' ( ID GEN ( P_y ( '->' TYPE )? )? | GEN1 ) )*",
        "TYPE": "( '&' lifetime_? mut? | '&&' lifetime_? mut? | '*' ( const | mut ) | dyn | impl | for GEN1 | '?' )* ( unsafe? ( extern STR? )? fn P_y ( '->' TYPE )? | PATHT ( '!' ( P_m | S_m | B_m ) )? | P_y | S_y | '!' | lifetime_ ) ( '+' '?'? ( lifetime_ | ( for GEN1 )? PATHT | P_y ) )*",
        "BOUNDS": "( '?'? ( lifetime_ | ( for GEN1 )? '?'? PATHT | P_y ) ( '+' '?'? ( lifetime_ | ( for GEN1 )? PATHT | P_y ) )* '+'? )?",
        "P_y": "( ( ID ':' )? ( TYPE | '...' ) ( ',' ( ID ':' )? TYPE )* ','? )?",
        "S_y": "TYPE ( ';' E )?",
        "PATH": "( GEN1 '::' )? '::'? ID ( '::' ( ID | GEN1 ) )*",
        "PAT0": "( '&' | '&&' | ref | mut )* ( ID '@' )? ( '-'? LIT ( ( '..=' | '..' ) ( '-'? LIT | PATH )? )? | PATH ( P_t | B_t | ( '..=' | '..' ) ( '-'? LIT | PATH )? | '!' P_m )? | P_t | S_t | '..' | '..=' ( LIT | PATH ) )",
        "PAT": "'|'? PAT0 ( '|' PAT0 )*",
        "P_t": "( PAT ( ',' PAT )* ','? )?", "S_t": "( ( ID '@' )? PAT ( ',' ( ID '@' )? PAT )* ','? )?",
        "B_t": "( ( ref? mut? ID | ( ID | LIT ) ':' PAT | '..' ) ( ',' ( ref? mut? ID | ( ID | LIT ) ':' PAT | '..' ) )* ','? )?",
        "CLOSURE": "( async? move? ( '|' ( PAT0 ( ':' TYPE )? ( ',' PAT0 ( ':' TYPE )? )* ','? )? '|' | '||' ) ( '->' TYPE (?= B_s ) )? )",
        "PRE": "( '!' | '-' | '*' | ( '&' | '&&' ) ( raw ( const | mut ) | mut )? | let PAT '=' | CLOSURE | return | break lifetime_? | yield )",
        "BLOCKY": "( ( lifetime_ ':' )? ( loop | while E | for PAT in E | unsafe | const | async move? )? B_s | if E B_s ( else if E B_s )* ( else B_s )? | match E B_w )",
        "ATOM": "( BLOCKY | LIT | PATH '!' ( P_m | S_m | B_m ) | PATH B_o? | P_e | S_e | continue lifetime_? | '..' )",
        "TAIL": "( '.' ( ID ( '::' GEN1 )? | LIT | await ) | P_e | S_e | '?' )",
        "U": "PRE* ( ATOM TAIL* | (?<= return | break ) | (?<= lifetime_ ) )",
        "BIN": f"( {_alternatives('== != <= && || += -= *= /= %= &= |= ^= <<= << ..= .. < + - * / % & | ^ =')} | '>' ( '>' | '=' )* )",
        "E": "( '..' | '..=' )? U ( as TYPE | BIN U | '..' (?! U ) )*",
        "P_e": "( E ( ',' E )* ','? )?",
        "S_e": "( E ( ',' E )* ','? | E ';' E )?",
        "MARG": "( '$' | '#' | E | PAT | TYPE | B_m | STMT1 )",
        "STMT1": "( <break continue return> )",
        "P_m": "( ( ID '=' )? MARG ( ( ',' | ';' | '=>' | if ) ( ID '=' )? MARG )* <, ;>? )?",
        "S_m": "( MARG ( ( ',' | ';' | '=' | '=>' ) MARG )* <, ;>? )?",
        "B_m": "(?s: . )*".replace("(?s: . )*", "ALL*"),
        "B_o": "( ATTR ( ( ID | LIT ) ( ':' E )? | '..' E ) ( ',' ATTR ( ( ID | LIT ) ( ':' E )? | '..' E ) )* ','? )?",
        "B_w": "( ATTR PAT ( if E )? '=>' ( BLOCKY ','? | E ( ',' | EOS ) ) )*",
        "WHERE": "( where ( ( for GEN1 )? ( TYPE | lifetime_ ) ':' BOUNDS ( ',' | (?= <; => | B_s | B_c | B_f | B_v | EOS ) ) )* )?".replace("<; =>", "';' | '='"),
        "VIS": "( pub ( P_e )? )?",
        "PARAM": "ATTR ( '&' lifetime_? mut? self | mut? self ( ':' TYPE )? | PAT0 ':' ( TYPE | '...' ) | '...' )",
        "P_p": "( PARAM ( ',' PARAM )* ','? )?",
        "FN": "( default | const | async | unsafe | extern STR? )* fn ID GEN P_p ( '->' TYPE )? WHERE ( B_s | ';' )",
        "P_f": "( ATTR VIS TYPE ( ',' ATTR VIS TYPE )* ','? )?",
        "B_f": "( ATTR VIS ID ':' TYPE ( ',' ATTR VIS ID ':' TYPE )* ','? )?",
        "B_v": "( ATTR ID ( P_f | B_f )? ( '=' E )? ( ',' ATTR ID ( P_f | B_f )? ( '=' E )? )* ','? )?",
        "TREE": "( '::'? ( ID '::' )* ( B_u | '*' | ID ( as ID )? ) )",
        "B_u": "( TREE ( ',' TREE )* ','? )?",
        "ITEM": "( ATTR VIS ( FN | struct ID GEN ( WHERE B_f | P_f WHERE ';' | ';' ) | enum ID GEN WHERE B_v | union ID GEN WHERE B_f | ( unsafe | default )* impl ( GEN1 )? const? '!'? TYPE ( for TYPE )? WHERE B_c | ( unsafe | auto )* trait ID GEN ( ':' BOUNDS )? WHERE B_c | use TREE ';' | mod ID ( B_n | ';' ) | ( const | static ) mut? ID ':' TYPE ( '=' E )? ';' | type ID GEN ( ':' BOUNDS )? WHERE ( '=' TYPE )? WHERE ';' | extern crate ID ( as ID )? ';' | unsafe? extern STR? B_c | macro_rules '!' ID ( B_m | P_m ';' ) | PATH '!' ( B_m | P_m ';' | S_m ';' ) ) | '#' '!' S_m )",
        "B_c": "ITEM*", "B_n": "ITEM*",
        "STEP": "( let PAT ( ':' TYPE )? ( '=' E )? | E )",
        "LEAD": "EMPTY",
        "STMT": "(?> ';' | ITEM | ATTR let PAT ( ':' TYPE )? ( '=' E ( else B_s )? )? ';' | ATTR E ';' | ATTR (?! let ) E EOS | BLOCKY )",
        "B_s": "( '#' '!' S_m )* STMT*",
        "TOP": "ITEM* ';'*",
    }
    return Grammar(words="as break const continue else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct trait true type unsafe use where while lifetime_", soft=soft,
                   signs="..= ... <<= -> => :: && || == != <= += -= *= /= %= &= |= ^= << ..", rules=rules, generic=f"i {soft} :: , & mut impl * const lifetime_ = : + ? ! LIT -> as for - true false fn GRP \x0f", before=(("''' ID", "lifetime_"), ("true | false", "i")),
                   number=r"0[xXbBoO][\w]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[A-Za-z]\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?")


_KT_MODS = "public private protected internal open abstract final sealed data enum inner inline noinline crossinline override lateinit const suspend operator infix external tailrec annotation companion vararg reified out expect actual value"


def _kotlin() -> Grammar:
    soft = f"{_KT_MODS} constructor init get set by where import catch finally field it dynamic"
    rules = {
        "T": "( ';' | NL | EOS )",
        "ANN": "( '@' ( ID ':' )? ( ID ( '.' ID )* GEN P_e? | S_e ) NL? )",
        "MOD": f"( ANN | <{_KT_MODS}> NL? | fun (?= interface ) )*",
        "T0": "( suspend? ( ID GEN ( '.' ID GEN )* | P_y ) '?'* )",
        "TYPE": "ANN* ( ( T0 '.' )? P_y '->' TYPE | T0 ( '&' T0 )* )",
        "P_y": "( ( ID ':' )? TYPE ( ',' ( ID ':' )? TYPE )* ','? )?",
        "AT": "( '@' ID )?",
        "PRE": "( '!' | '-' | '+' | '++' | '--' | throw | return AT | ANN | ID '@' )",
        "BODY": "( B_s | S1 )",
        "IFE": "if P_1 NL? ( BODY? ';'? NL? else NL? BODY | BODY | ';' )",
        "ATOM": "( IFE | when P_w? B_w | try B_s ( NL? catch P_k B_s )* ( NL? finally B_s )? | <data>? object ( ':' SUPERS )? B_c | suspend? fun ( TYPE '.' )? P_p ( ':' TYPE )? ( B_s | '=' E ) | ID GEN | LIT | <null true false> | this AT | super GEN AT | P_1 | S_e | B_l | '::' ( ID | class ) | <break continue> AT )",
        "TAIL": "( <. ?.> ( ID GEN | class | P_1 ) | P_e ( ( ID '@' )? B_l )? | S_e | '!!' | ( ID '@' )? B_l | '?'? '::' ( ID | class ) )",
        "U": "PRE* ( ATOM TAIL* <++ -->? | (?<= return ) | (?<= '@' ID ) )",
        "BIN": f"( {_alternatives('=== !== == != <= >= && || ?: .. ..< + - * / % < >')} | in | '!in' | ID )",
        "E": "U ( BIN U | is TYPE | '!is' TYPE | <as as_q> TYPE )*",
        "S1": "( E ( <= += -= *= /= %=> E )? )",
        "P_1": "E", "P_w": "( ANN* val ID ( ':' TYPE )? '=' )? E",
        "P_e": "( ( ID '=' )? '*'? E ( ',' ( ID '=' )? '*'? E )* ','? )?",
        "S_e": "( E ( ',' E )* ','? )?",
        "PARAM": "MOD ( val | var )? ID ':' TYPE ( '=' E )?",
        "P_p": "( NL? PARAM ( ',' PARAM )* ','? )?",
        "P_d": "( ID ( ':' TYPE )? ( ',' ID ( ':' TYPE )? )* ','? )",
        "P_f": "ANN* ( ID ( ':' TYPE )? | P_d ) in E",
        "P_k": "ID ':' TYPE ','?",
        "WHERE": "( where ID ':' TYPE ( ',' ID ':' TYPE )* )?",
        "ACC": "( NL? MOD <get set> ( ( P_p | P_d )? ( ':' TYPE )? ( B_s | '=' NL? E ) )? ( NL | ';' )? )",
        "DECL": "MOD ( val | var ) GEN ( T0 '.' )? ( ID | P_d ) ( ':' TYPE )? WHERE ( ( '=' | by ) NL? E )?",
        "FUN": "MOD fun GEN ( T0 '.' )? ID GEN P_p ( ':' TYPE )? WHERE ( B_s | '=' NL? S1 )?",
        "SUPERS": "TYPE ( P_e )? ( by E )? ( ',' TYPE ( P_e )? ( by E )? )*",
        "CLS": "MOD ( ( class | interface ) ID GEN | object ID? ) ( ( MOD constructor )? P_p )? ( ':' SUPERS )? WHERE ( B_c | B_n )?",
        "ALIAS": "MOD typealias ID GEN '=' TYPE",
        "STEP": "( DECL | S1 )",
        "LEAD": "EMPTY",
        "STMT": "(?> ';' | NL | ( DECL | FUN | CLS | ALIAS | ( ID '@' )? ( for P_f | while P_1 ) NL? ( BODY | (?= ';' ) ) | ( ID '@' )? do BODY NL? while P_1 | S1 ) T | NL | ';' )",
        "B_s": "STMT*",
        "B_l": "( NL? ( ( ID ( ':' TYPE )? | P_d ) ( ',' ( ID ( ':' TYPE )? | P_d ) )* )? '->' )? STMT*",
        "COND": "( E | in E | '!in' E | is TYPE | '!is' TYPE )",
        "B_w": "NL? ( ( COND ( ',' NL? COND )* ','? | else ) '->' NL? ( B_s | STMT0 ) T+ )*".replace("STMT0", "S1"),
        "MEMBER": "(?> ( init B_s | MOD constructor P_p ( ':' <this super> P_e )? B_s? | DECL T ACC* | FUN T | CLS T | ALIAS T | NL | ';' ) )",
        "B_c": "( MEMBER | T0_ )*".replace(" | T0_", ""),
        "B_n": "NL? ( ANN* ID P_e? B_c? ( ',' NL? ANN* ID P_e? B_c? )* ','? NL? ( ';' MEMBER* )? )?",
        "TOP": "NL? ( '@' ID ':' ( ID ( '.' ID )* P_e? | S_e ) NL )* ( package ID ( '.' ID )* T )? NL? ( import ID ( '.' ID )* ( '.' '*' )? ( as ID )? T )* ( ( DECL T ACC* | FUN T | CLS T | ALIAS T | NL | ';' ) )*",
    }
    return Grammar(words="as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while as_q", soft=soft,
                   signs="=== !== ..< ?. ?: :: -> ++ -- == != <= >= && || !! .. += -= *= /= %= !in !is", rules=rules, generic=f"i {soft} . , ? : * in -> & GRP \x0f",
                   ends=f"i {soft} LIT ) ] }} > ? this super null true false return break continue object !! ++ --", not_before=". ?. ?: , ) ] : = && || -> as by else where { += -= *= /= == !=".replace(" else", "").replace(" where", ""),
                   before=(("as '?'", "as_q"), ("(?<= '.' ) '*'", "i")), wider="B_l")


def _swift() -> Grammar:
    mods = "public private fileprivate internal open static final override mutating nonmutating lazy weak unowned required convenience indirect dynamic optional nonisolated isolated consuming borrowing prefix postfix infix package class_"
    soft = f"{mods} get set willSet didSet some any async await actor protocol_ precedencegroup Type left right associativity higherThan lowerThan each macro then unsafe safe"
    rules = {
        "T": "( ';' | NL | EOS )",
        "ANN": "( '@' ID ( '.' ID )* P_e? NL? | '#' ID P_e? NL? )",
        "MOD": f"( ANN | <{mods}> P_m? NL? | class (?= func | var | let | subscript ) )*",
        "P_m": "ID",
        "TYPE": "( ANN | inout | some | any | each | borrowing | consuming | isolated )* ( ( P_y ( async )? ( throws | rethrows )? '->' TYPE ) | T0 ( '&' T0 )* )",
        "T0": "( ID GEN ( '.' ( ID | protocol_ ) GEN )* | P_y | S_y | <Self_ self> ) ( <? !> | '??' | '.' ID )*".replace("<Self_ self>", "self"),
        "P_y": "( ( ID ID? ':' )? TYPE '...'? ( '=' E )? ( ',' ( ID ID? ':' )? TYPE '...'? ( '=' E )? )* )?",
        "S_y": "TYPE ( ':' TYPE )?",
        "PRE": "( <! - + ~ & ...> | '..<' | try <! ?>? | await | <inout> )",
        "ATOM": "( ID GEN | LIT | <self super nil true false> | P_e | S_e | B_l | '.' ( ID | init | self | LIT ) GEN | '#' ID P_e? | <if> IFC B_s ( else if IFC B_s )* else B_s | switch E B_w | '\\' T0? ( '.' ( ID | self ) <? !>* | S_e )* | '_' )".replace(" | '_'", ""),
        "TAIL": "( '?'? '.' ( ID | init | self | LIT | <default in is as for if> ) GEN | '!' | '?' (?= <. [> | S_e | P_e ) | P_e ( B_l ( ID ':' B_l )* )? | S_e | B_l ( ID ':' B_l )* )".replace("(?= <. [> | S_e | P_e )", ""),
        "U": "PRE* ATOM TAIL* ( '...' (?! U ) )?",
        "BIN": f"( {_alternatives('=== !== ~= &+ &- &* == != <= >= && || ?? ... ..< += -= *= /= %= &= |= ^= <<= >>= << >> = + - * / % & | ^ TERN < > ->')} )",
        "E": "U ( BIN U | is TYPE | as <? !>? TYPE )*",
        "TERNARY": "E",
        "P_e": "( ( ID ':' )? ( E | <+ - * / < > & |> | '==' ) ( ',' ( ID ':' )? ( E | <+ - * /> ) )* ','? )?".replace(" < > ", " "),
        "S_e": "( E ( ':' E )? ( ',' E ( ':' E )? )* ','? | ':' | <weak unowned> ( ID | self ) ( '=' E )? ( ',' <weak unowned>? ( ID | self ) ( '=' E )? )* )?",
        "PAT": "( ( let | var )? ( P_t | '.' ID P_t? | ID ( '.' ID )* P_t? ) '?'? | E | is TYPE | ( let | var )? ID ( as TYPE )? )",
        "P_t": "( ( ID ':' )? PAT ( ',' ( ID ':' )? PAT )* )?",
        "COND": "( ( let | var ) ( ID | P_t ) ( ':' TYPE )? ( '=' E )? | case PAT ( ':' TYPE )? '=' E | '#' ID P_e | E )",
        "IFC": "COND ( ',' COND )*",
        "WHERE": "( where E ( ',' E )* | where TYPE ( ':' | '==' ) TYPE ( ',' TYPE ( ':' | '==' ) TYPE )* )?",
        "PARAM": "ANN* ( WORD ID? ':' TYPE '...'? ( '=' E )? )",
        "P_p": "( PARAM ( ',' PARAM )* ','? )?",
        "EFFECT": "( async | throws P_e? | rethrows | reasync_ )*".replace(" | reasync_", ""),
        "FUN": "MOD ( func ( ID | operator_ ) GEN P_p NL? EFFECT ( '->' TYPE )? WHERE B_s? | init <? !>? GEN P_p EFFECT WHERE B_s? | deinit B_s | subscript GEN P_p '->' TYPE WHERE ( B_q | B_s ) )",
        "BINDING": "( ID | P_t ) ( ':' TYPE )? ( '=' E )? ( B_q | B_s )?",
        "DECL": "MOD ( let | var ) BINDING ( ',' BINDING )*",
        "CLS": "MOD ( class | struct | enum | protocol | extension | actor ) T0 ( ':' TYPE ( ',' TYPE )* )? NL? WHERE ( B_c )",
        "OTHER": "( MOD typealias ID GEN '=' TYPE WHERE | MOD associatedtype ID ( ':' TYPE ( ',' TYPE )* )? ( '=' TYPE )? WHERE | MOD import ( <class struct enum protocol let var func typealias> )? ID ( '.' ID )* | MOD <operator> ANYOP | precedencegroup ID B_g | MOD indirect? case ID P_y? ( '=' E )? ( ',' ID P_y? ( '=' E )? )* )".replace("MOD <operator> ANYOP", "MOD operator operator_? ( ':' ID )?"),
        "B_g": "( ID ':' ( ID | <true false> ) NL? )*",
        "STEP": "( MOD ( let | var ) ( ID | P_t ) ( ':' TYPE )? ( '=' E )? | E | return E? | throw E | <break continue> ID? | fallthrough )",
        "LEAD": "EMPTY",
        "IF": "if IFC B_s ( NL? else if IFC B_s )* ( NL? else B_s )?",
        "STMT": "(?> ';' | NL | ( ( ID ':' )? ( IF | for ( await | try )* ( case )? ( PAT ) ( ':' TYPE )? in E WHERE B_s | while IFC B_s | repeat B_s NL? while E | switch E B_w | do ( throws P_e )? B_s ( NL? catch ( PAT ( ',' PAT )* WHERE )? B_s )* ) | guard IFC else B_s | defer B_s | FUN | CLS | OTHER | DECL | return E? | throw E | <break continue> ID? | fallthrough | E ) T | NL | ';' | '#' ID E? NL )",
        "B_s": "STMT*",
        "B_l": "( NL? S_e? ( ( ID ( ',' ID )* | P_p | P_t ) NL? EFFECT ( '->' TYPE )? )? in NL? )? STMT*",
        "B_w": "NL? ( ( ( '@' ID )? case PAT WHERE ( ',' NL? PAT WHERE )* | ( '@' ID )? default ) ':' STMT* )*",
        "B_q": "NL? ( MOD <get set willSet didSet> P_t? EFFECT B_s? ( NL | ';' )? )+",
        "MEMBER": "(?> ( FUN | CLS | OTHER | DECL ) T | NL | ';' | '#' ID E? NL )",
        "B_c": "MEMBER*",
        "TOP": "( STMT )*",
    }
    words = "as associatedtype break case catch class continue default defer deinit do else enum extension fallthrough false fileprivate_ for func guard if import in init inout is let nil operator protocol repeat rethrows return self struct subscript super switch throw throws true try typealias var where while operator_"
    return Grammar(words=words, soft=soft, signs="=== !== ..< ... -> ?? == != <= >= && || += -= *= /= %= &= |= ^= <<= << ~= &+ &- &*", rules=rules, generic=f"i {soft} . , ? : & = -> self GRP \x0f",
                   ends=f"i {soft} LIT ) ] }} > ? ! self super nil true false break continue return fallthrough init default", not_before=". , ) ] : ? = && || ?? -> + * / == != <= < += -= *= { in ..< ... is as where & | catch TERN".replace(" catch", "").replace(" { ", " { "),
                   before=(("(?<= func ) ( <+ - * / % & | ^ ! ~ < ? = == != <= += -= *= << && || ?? ... ..<> | '>' )+".replace("<+ - * / % & | ^ ! ~ < ? = == != <= += -= *= << && || ?? ... ..<>", _alternatives("+ - * / % & | ^ ! ~ < ? = == != <= += -= *= << && || ?? ... ..<")), "operator_"),), wider="B_l")


def _ruby() -> Grammar:
    rules = {
        "T": "( ';' | NL )",
        "CALLEE": "( ATOM TAIL0* <. &.> )? ( ID | super | yield )",
        "ARG": "( <* ** &> E? | label_ NL? E? | STR ':' E | E ( '=>' NL? E )? | CMD )",
        "ARGS": "ARG ( ',' ARG )*",
        "CMD": "CALLEE ARGS",
        "PRE": "( <! - + ~ & * **> | not | 'defined?' | label0_ )".replace(" | label0_", "").replace("'defined?'", "defined_"),
        "ATOM": "( STR+ | LIT | ID | B_h | B_k | <self nil true false super yield redo retry> | P_1 | S_e | '->' ( P_p | ID ( ',' ID )* )? ( B_b | B_k ) | '::' ID | endless_ ( ( self | ID ) '.' )? WORD P_p? '=' ( CMD | E ) )",
        "TAIL0": "( <. &.> ( WORD | P_e ) | '::' WORD | P_e | S_e | B_b | B_k )",
        "TAIL": "TAIL0",
        "U": "PRE* ATOM TAIL*",
        "BIN": f"( {_alternatives('=== <=> == =~ !~ != <= >= && || **= &&= ||= += -= *= /= %= |= &= <<= << >> ** ... .. = + - * / % & | ^ < > TERN')} | and | or )",
        "E": "U ( BIN NL? U )* <.. ...>?",
        "TERNARY": "( CMD | E )",
        "SIDE": "( <* **>? U )",
        "ASSIGN": "( SIDE ( ',' SIDE )* ','? ( '=' | <+= -= *= /= ||= &&= <<=> ) )+".replace("<+= -= *= /= ||= &&= <<=>", _alternatives("+= -= *= /= ||= &&= <<=")),
        "S1": "( ( ASSIGN ( not | '!' )? ( CMD | ARGS ) | ( not | '!' )? ( CMD | E ) ) ( ( and | or | BIN ) NL? ( not | '!' )? ( CMD | E ) )* | <return break next> ( CMD | ARGS )? | alias WORD WORD | undef ARGS )",
        "S": "S1 ( <if unless while until rescue> ( CMD | E ) | ( and | or ) NL? S1 )*",
        "STMTS": "( S ( T | EOS | (?= <end_ else elsif when ensure rescue in> ) ) | T )*",
        "THEN": "( then | T then? )",
        "BODY": "STMTS ( rescue ( E ( ',' E )* )? ( '=>' U )? THEN STMTS )* ( else STMTS )? ( ensure STMTS )?",
        "PARAM": "( <* ** &> ID? | label_ E? | ID ( '=' E )? | P_p | '...' )",
        "BARS": "( '|' ( PARAM ( ',' PARAM )* ','? ( ';' ID ( ',' ID )* )? )? '|' | '||' )",
        "P_1": "STMTS",
        "P_e": "( ARG ( ',' ARG )* ','? )?",
        "P_p": "( PARAM ( ',' PARAM )* )?",
        "S_e": "( ARG ( ',' ARG )* ','? )?",
        "B_h": "( ( label_ NL? E? | STR ':' E | E '=>' E | '**' E ) ( ',' ( label_ NL? E? | STR ':' E | E '=>' E | '**' E ) )* ','? )?",
        "B_b": "BARS? BODY",
        "NAME": "( ( self | ID ) '.' )? ( WORD '='? | <+ - * / % ! == != < > << >> <=> =~ === [ & |> )".replace("<+ - * / % ! == != < > << >> <=> =~ === [ & |>", _alternatives("+ - * / % ! == != < > << >> <=> =~ === & | ~ ^ **") + " | S_e '='?"),
        "B_k": "( def NAME ( P_p | PARAM ( ',' PARAM )* )? T? BODY | class ( '::'? ID ( '::' ID )* ( '<' E )? | '<<' E ) T? BODY | module '::'? ID ( '::' ID )* T? BODY | <if unless> S THEN STMTS ( elsif S THEN STMTS )* ( else STMTS )? | <while until> S T STMTS | for ID ( ',' ID )* in E T STMTS | case E? T+ ( when ARGS THEN STMTS )+ ( else STMTS )? | case E? T+ ( in ANY* THEN STMTS )+ ( else STMTS )? | begin BODY | do BARS? BODY ) end_",
        "TOP": "STMTS",
    }
    ends = "i LIT ) ] } self nil true false super yield redo retry return break next end_ label_ | then do begin else ensure ?".replace(" | then do begin else ensure ?", "")
    operand = "( i | LIT | ')' | ']' | '}' | end_ | <self nil true false super yield redo retry return break next> )".replace("i | ", "ID | ")
    return Grammar(words="alias and begin case class def do else elsif ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield break end_ label_ defined_ endless_", soft="",
                   signs="=== <=> **= &&= ||= <<= ... &. => -> == =~ !~ != <= >= && || += -= *= /= %= |= &= << >> ** :: ..", rules=rules, ends=ends + " |", not_before=". &. , ) ] } = => && || ? : then".replace(" then", ""),
                   extra=(r"(?<![\w:)\]\x01]):[A-Za-z_]\w*[?!]?|(?<![\w.])[A-Za-z_]\w*[?!]?:(?!:)|@{0,2}[A-Za-z_]\w*[?!](?!=)|@{1,2}[A-Za-z_]\w*", "label_"),
                   before=((f"(?<! {operand} ) (?= <if unless while until case for> ) (?<! '.' )", "{"), ("(?<! '.' ) (?= <begin do> )", "{"), ("(?<! '.' ) (?<! def ) (?= <def class module> )", "{")))


def _sql() -> Grammar:
    soft = "by update delete insert values between over filter partition rows range groups unbounded preceding following current row exists interval key if temp temporary unlogged materialized recursive view index function procedure trigger policy role set nulls first last escape at time zone lateral_ conflict nothing overriding system value ordinality within share of no action cascade restrict match simple generated always identity stored replace concurrently without enable storage local double precision varying type schema extension sequence domain database begin commit rollback start transaction savepoint release abort work alter drop add rename owner comment truncate analyze_ vacuum explain copy call execute prepare deallocate lock refresh reindex cluster notify listen unlisten security discard checkpoint declare close reassign load reset show merge language revoke before after instead each statement uuid rule aggregate operator server publication subscription event import return returns prior next rowtype"
    rules = {
        "NAME": "( ID | STR ) ( '.' ( ID | STR ) )*",
        "TYPE": "( interval | ID ( '.' ID )* ) ( precision | varying )? P_n? ( <with without> time zone )? P_n? S_e* array?",
        "P_n": "( LIT | ID ) ( ',' ( LIT | ID ) )*",
        "PRE": "( <- + ~ @ not any all some array exists variadic> | distinct )",
        "CASE": "case E? ( when E then E )+ ( else E )? end",
        "ATOM": "( B0 | LIT | NAME ( '.' '*' )? | <null true false default user current_> | P_q | S_e | cast P_c | interval STR ( ID ( to ID )? )? | TYPE STR | case_ | '*' | <left right> )".replace("B0 | ", ""),
        "TAIL": "( P_e ( within group P_w )? ( filter P_w )? ( over ( ID | P_w ) )? | S_e | '::' TYPE | at time zone U0 | collate NAME | '.' ( ID | '*' ) )".replace("at time zone U0", "at time zone ( LIT | NAME )"),
        "U": "PRE* ATOM TAIL*",
        "BIN": f"( {_alternatives('<> != <= >= || ->> -> #>> #> @> <@ && ~* !~* !~ = < > + - * / % ^ ~ & |')} | '@' '@' | and | or | not? ( in | like | ilike | similar to | between ( symmetric )? ) | overlaps_ | '?' | operator P_e )".replace(" ( symmetric )?", "").replace(" | overlaps_", ""),
        "E": "U ( BIN U | is not? ( null | true | false | ID | distinct from U ) | isnull | notnull | escape LIT )*",
        "ES": "E ( ',' E )*",
        "P_q": "( QUERY | ES | INSERT | UPDATE | DELETE )", "P_e": "( ( distinct | all )? ( ( ID ( '=>' | ':=' ) )? E ( ',' ( ID ( '=>' | ':=' ) )? E )* ) ( order by ORDER )? | QUERY | ID from E | E from E ( for E )? | ID in_ E )?".replace(" | ID in_ E", " | E in E"),
        "P_c": "E as TYPE",
        "P_w": "where E | ID? ( partition by ES )? ( order by ORDER )? ( <rows range groups> FRAME )?",
        "FRAME": "( between BOUND and BOUND | BOUND )",
        "BOUND": "( <unbounded> <preceding following> | current row | E <preceding following> )",
        "ORDER": "E ( asc | desc )? ( using ANY )? ( nulls <first last> )? ( ',' E ( asc | desc )? ( nulls <first last> )? )*",
        "S_e": "( E? ( ':' E? )? ( ',' E )* )?",
        "ALIAS": "( as? ( ID | STR ) P_q? | as P_t )?",
        "ITEM": "E ( as ( ID | STR | WORD ) | ID | STR )?",
        "REF": "only? lateral? ( NAME ( '*' )? P_e? | P_q | P_j ) ( with ordinality )? ALIAS",
        "P_j": "JOINED",
        "JOINED": "REF ( natural? ( inner | cross | ( left | right | full ) outer? )? join REF ( on E | using P_q ALIAS )? )*",
        "FROM": "from JOINED ( ',' JOINED )*",
        "BASE": "( select ( all | distinct ( on P_q )? )? ( ITEM ( ',' ITEM )* )? FROM? ( where E )? ( group by ( distinct )? ES )? ( having E )? ( window ID as P_w ( ',' ID as P_w )* )? | values P_q ( ',' P_q )* | table NAME | P_q )",
        "TAILS": "( order by ORDER )? ( limit ( all | E ) | offset E ( <row rows> )? | fetch <first next> E? <row rows> only | for ( update | share | no key update | key share ) ( of NAME )? ID? ID? )*",
        "WITH": "( with recursive? ID P_q? as ( not? materialized )? P_q ( ',' ID P_q? as ( not? materialized )? P_q )* )",
        "QUERY": "WITH? ( select | values | table | P_q ) ANY0".replace("( select | values | table | P_q ) ANY0", "BASE ( ( union | intersect | except ) ( all | distinct )? BASE )* TAILS"),
        "RET": "( returning ITEM ( ',' ITEM )* )?",
        "SETS": "( ( NAME S_e* | P_q ) '=' E ) ( ',' ( NAME S_e* | P_q ) '=' E )*",
        "INSERT": "WITH? insert into NAME ( as ID )? P_q? ( overriding ( user | system ) value )? ( values P_q ( ',' P_q )* | default values | QUERY ) ( on conflict ( P_q ( where E )? | on constraint NAME )? do ( nothing | update set SETS ( where E )? ) )? RET",
        "UPDATE": "WITH? update only? NAME ( as? ID )? set SETS FROM? ( where E )? RET",
        "DELETE": "WITH? delete from only? NAME ( as? ID )? ( using JOINED ( ',' JOINED )* )? ( where E )? RET",
        "ACTION": "( on ( delete | update ) ( cascade | restrict | no action | set ( null | default ) P_q? ) | match ( full | simple | ID ) | not? deferrable | initially ID )*",
        "CON": "( ( constraint NAME )? ( not null | null | primary key | unique ( nulls not? distinct )? | default E | references NAME P_q? ACTION | check P_q ( no ID )? | generated ( always | by default ) as ( identity P_z? | P_q stored ) | collate NAME ) ACTION )*",
        "P_z": "ANY*",
        "P_t": "( COLUMN ( ',' COLUMN )* )?",
        "COLUMN": "( ( constraint NAME )? ( primary key P_q | unique ( nulls not? distinct )? P_q | check P_q | foreign key P_q references NAME P_q? ACTION | exclude_ ANY* ) ACTION | like NAME ( ID ID )* | ( ID | STR ) TYPE CON )".replace(" | exclude_ ANY*", ""),
        "TABLE": "create ( local | temp | temporary | unlogged )* table ( if not exists )? NAME ( P_t | P_q )? ( as QUERY | ( partition by ID P_q | with P_q | ID P_q | on commit ID ID | without ID | tablespace_ ID )* ( as QUERY )? )".replace(" | tablespace_ ID", ""),
        "VIEW": "create ( or replace )? ( temp | temporary | recursive | materialized )* view ( if not exists )? NAME P_q? ( with P_q )? as QUERY ( with ( no ID | ANY* ) )?",
        "INDEX": "create unique? index concurrently? ( if not exists )? NAME? on only? NAME ( using ID )? P_i ( ID P_q )? ( nulls not? distinct )? ( with P_q )? ( where E )?",
        "P_i": "E ID? ( asc | desc )? ( nulls <first last> )? ( ',' E ID? ( asc | desc )? ( nulls <first last> )? )*",
        "DONE": "( (?<! ',' | '.' | '=' | and | or | not | where | from | select | join | on | as | in | is | into | table | references | default | primary | like | having | limit | union | group | order | create ) )",
        "OTHER": "( create ( or replace )? ( function | procedure ) NAME P_z ANY* ( as | return | returns | begin | language ) ANY* | create ( or replace )? constraint? trigger NAME ( before | after | instead of ) ANY* execute ( function | procedure ) NAME P_e | create policy ( NAME ) on NAME ANY* | create ( user | role | group | database | schema | extension | sequence | type | domain | server | aggregate | cast | collate | operator | rule | publication | subscription | event | foreign | language | ID ) ANY+ | alter ( table | role | user | index | view | function | database | schema | sequence | type | policy | group | default | domain | extension | system | materialized | ID ) ANY+ | drop ( table | view | index | function | schema | sequence | type | role | user | policy | trigger | database | extension | materialized | procedure | domain | group | ID ) ANY+ | grant ANY+ to ANY+ | revoke ANY+ from ANY+ | ( set | reset | show ) ANY+ | comment on ANY+ is ( STR | null ) | do ANY* STR ANY* | ( begin | commit | rollback | start transaction | end | abort | savepoint | release ) WORD* | ( truncate | analyze | vacuum | explain | copy | call | execute | prepare | deallocate | lock | refresh | reindex | cluster | notify | listen | unlisten | security | discard | checkpoint | declare | fetch | close | reassign | load ) ANY* | import foreign ANY+ | merge into ANY+ ) DONE",
        "TOP": "( ( INSERT | UPDATE | DELETE | TABLE | VIEW | INDEX | QUERY | OTHER )? ( ';' | EOS ) )*",
    }
    rules["ATOM"] = rules["ATOM"].replace("case_", "CASE").replace("current_> ", "> ").replace(" current_", "")
    words = "all analyze and any array as asc case cast check collate constraint create cross default deferrable desc distinct do else end except false fetch for foreign from full grant group having ilike in initially inner intersect into is isnull join lateral left like limit natural not notnull null offset on only or order outer primary references returning right select similar some table then to true union unique user using variadic when where window with"
    return Grammar(words=words, soft=soft, signs="!~* ->> #>> :: := => <> != <= >= || -> #> @> <@ && ~* !~", rules=rules, number=r"\$\d+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?[A-Za-z]\w*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+")


_MAKERS = {"javascript": _javascript, "typescript": _typescript, "java": _java, "csharp": _csharp, "dart": _dart, "cpp": _cpp, "go": _go, "rust": _rust, "kotlin": _kotlin, "swift": _swift, "ruby": _ruby, "sql": _sql}


@cache
def grammar(language: str) -> Grammar:
    return _MAKERS[language]()


def plain(text: str) -> str:
    """Text without a mark of byte order and carriage returns; a first line for a shell is blank."""
    t = text.removeprefix("\ufeff").replace("\r\n", "\n")
    return "\n" + t.partition("\n")[2] if t.startswith("#!") else t


def prepared(language: str, text: str) -> str:
    """Masked text as the grammars take it."""
    return ready(language, mask(language, plain(text), TICK))


def ready(language: str, m: str) -> str:
    """Masked text of a language as its grammar takes it: without preprocessor lines, what depends on lines settled."""
    if language == "sql":
        return m.lower()
    if language == "ruby":
        m = re.sub(r"^([ \t]*)def([ \t]+[\w.?!]+(?:\([^\n]*\))?[ \t]*=[ \t])", r"\1endless_\2", m, flags=re.M)
        m = re.sub(r"^([ \t]*(?:while|until|for)\b[^\n]*)\bdo[ \t]*$", r"\1", m, flags=re.M)
        m = re.sub(r"\bdefined\?", "defined_", m)
        return re.sub(r"(?<![\w.@$:])end\b(?![?!:\w])", "end_ }", re.sub(r"^__END__$[\s\S]*", "", m, flags=re.M))
    if language in ("cpp", "csharp"):
        m = re.sub(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", "", m, flags=re.M)
    return m

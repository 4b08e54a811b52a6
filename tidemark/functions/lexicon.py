"""Word lists and patterns that results depend on."""

from __future__ import annotations

#: Tool words of French, then of English, which carry no content.
STOP_WORDS = tuple(
    """
    le la les l un une des du de d au aux a à et ou mais donc or ni car que qu qui quoi dont ou où
    ce c cet cette ces ca ça cela ceci il ils elle elles on je j tu nous vous me m te t se s lui leur
    leurs y en ne n pas plus moins tres très bien tout tous toute toutes mon ma mes ton ta tes son sa
    ses notre nos votre vos est es suis sont sommes etes êtes ete été etre être ai as avons avez ont
    avoir fait faire va vais vas vont allons allez aller dans par pour sur sous avec sans chez entre
    vers comme si alors puis aussi encore deja déjà meme même voila voilà ben bon bah oui non ok okay
    quand comment pourquoi parce peu fois ici la là
    the a an and or but so of to in on at by for with
    from as is are was were be been am i you he she it we they me him her us them my your his its our
    their this that these those there here what which who how why when do does did have has had will
    would can could should not no yes just very really then also well like gonna going get got
    """.split()
)

#: Words said beside the talk, and those that make a passage such an aside.
ASIDE_WORDS = tuple(
    """
    attends attendez pardon excuse excusez excuse-moi excusez-moi desole désolé desolee désolée moi
    je j on recommence recommencer recommence reprends reprend reprendre refais refait refaire la le
    l c c'est est bon ok okay ca ça tourne coupe coupez zut mince merde oups non oh la là encore une
    fois again sorry wait hang let me start over one more time take oops cut i'll i'm it that s again
    so un deux trois go vas-y allez enfin plutôt plutot
    """.split()
)
ASIDE_TRIGGERS = tuple(
    """
    attends attendez pardon excuse excusez excuse-moi excusez-moi desole désolé desolee désolée
    recommence recommencer reprends refais refait refaire coupe coupez zut mince merde oups sorry
    wait again oops cut
    """.split()
)

#: Fixed value: hesitations, as word forms.
FILLER = "^(e+u+h*|h+e+u+h*|h*u+m+|h*m+h*|u+h+|e+r+m+|a+h+|o+h+|bah|ben)$"

#: Function words that tell a language.
FUNCTION_WORDS = {
    "fr": tuple("le la les de des du et est un une que qui nous il ils elle pour dans ce c'est pas sur vous je avec mais donc".split()),
    "en": tuple("the is are and of to we have that this with will be you it's there what from they our has was for not so".split()),
}

#: Common spoken words that dictionaries lack, noises that no second listening mends, and what French elides.
SPOKEN = {
    "fr": tuple("ok okay ouais ouah waouh wouah youpi bah ben bof hop pff ouf oups chut ah oh eh hé".split()),
    "en": tuple("ok okay yeah yep nope gonna wanna gotta kinda sorta ah oh hey wow".split()),
}
NOISES = ("ha", "haha", "hahaha", "eh", "hé", "he")
ELISIONS = ("l'", "d'", "j'", "m'", "n'", "s'", "t'", "c'", "qu'", "jusqu'", "lorsqu'", "puisqu'", "quoiqu'")
